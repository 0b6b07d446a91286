"""Terms of the tagged editions: one spelling for each term, redelivered tokens counted once."""

from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Tokens of one paragraph that stay together when copies are removed; bounds the size of such a group.
TOKENS_PER_BLOCK = 4096


def spelled(word: str | None) -> str | None:
    """Composed lower case without blanks around; what is blank is no term."""
    return (normalize("NFC", normalize("NFC", word.strip()).lower()) or None) if word is not None else None


@arrow_udf(T.StringType())
def term_of(words: pa.Array) -> pa.Array:
    """Composed lower case without blanks around; what is blank becomes null."""
    coded = words.dictionary_encode()
    return pa.array(map(spelled, coded.dictionary.to_pylist()), pa.string()).take(coded.indices)


def delivered_once(tokens: DataFrame) -> DataFrame:
    """Tokens without copies: rows with the same place, form and lemma are one. Nulls compare as equal.

    The rows are spread by section, paragraph and block of tokens, so that no section is one task's work.
    """
    keys = ["section_id", "par_n", "_block", "tok_n", "form", "lemma"]
    return (
        tokens.select("section_id", "par_n", "tok_n", "form", "lemma")
        .withColumn("_block", F.expr(f"tok_n div {TOKENS_PER_BLOCK}"))
        .repartition("section_id", "par_n", "_block")
        .dropDuplicates(keys)
        .drop("_block")
    )
