"""Unknown forms corrected by a dictionary: candidates by distance, the tag must fit."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def _keys(most: int):
    @arrow_udf(T.ArrayType(T.StringType()))
    def keys(words: pa.Array) -> pa.Array:
        """The word with up to `most` characters left out."""
        return pa.array([sorted({"".join(c) for k in range(min(most, len(w)) + 1) for c in combinations(w, len(w) - k)}) if w else [] for w in words.to_pylist()], pa.list_(pa.string()))

    return keys


def candidates(forms: DataFrame, dictionary: DataFrame, most: int = 1) -> DataFrame:
    """(form, tag, candidate, interps, distance) for distinct (form, tag): dictionary forms within `most` edits, met by the deletes that both share."""
    asked = forms.select("form", "tag").where("form is not null").distinct()
    keyed = asked.select("form").distinct().select("form", F.explode(_keys(most)("form")).alias("key"))
    index = dictionary.select(F.col("form").alias("candidate"), F.explode(_keys(most)("form")).alias("key"))
    near = keyed.join(index, "key").select("form", "candidate").distinct().withColumn("distance", F.levenshtein("form", "candidate", most)).where("distance > 0")
    return asked.join(near, "form").join(dictionary.select(F.col("form").alias("candidate"), "interps"), "candidate")


def correct_tokens(tokens: DataFrame, dictionary: DataFrame, use_lemmas: bool = False, most: int = 1) -> DataFrame:
    """tokens with unknown forms replaced by the nearest dictionary form, and then marked corrected instead of unknown.

    Candidates that the dictionary knows with the token's tag come first, then the smaller distance, then the
    form itself. With lemmas, dictionary entries are lemma:tag, a candidate must fit the tag, and its lemma is
    taken over. Forms without candidate stay as they are. Null forms stay.
    """
    tagged = tokens.withColumn("tag", F.array_join("interp", ":"))
    asked = tagged.where(F.coalesce("unknown_form", F.lit(False)))
    found = candidates(asked, dictionary, most)
    if use_lemmas:
        fits = F.filter("interps", lambda x: F.substring_index(x, ":", -1).isNotNull() & (F.regexp_replace(x, "^[^:]*:", "") == F.col("tag")))
        found = found.withColumn("fit", fits).where(F.size("fit") > 0).withColumn("new_lemma", F.substring_index(F.get("fit", F.lit(0)), ":", 1)).withColumn("rank", F.lit(0))
    else:
        found = found.withColumn("rank", (~F.array_contains("interps", F.col("tag"))).cast("int")).withColumn("new_lemma", F.lit(None).cast("string"))
    best = found.groupBy("form", "tag").agg(F.min(F.struct("rank", "distance", F.col("candidate"), "new_lemma")).alias("best"))
    joined = asked.join(best.select("form", "tag", F.col("best.candidate").alias("_to"), F.col("best.new_lemma").alias("_lemma")), ["form", "tag"], "left")
    hit = F.col("_to").isNotNull()
    fixed = joined.withColumns({
        "form": F.when(hit, F.replace("_to", F.lit(" "), F.lit("_"))).otherwise(F.col("form")), "lemma": F.coalesce("_lemma", "lemma"),
        "unknown_form": F.when(hit, False).otherwise(F.col("unknown_form")), "corrected": F.when(hit, True).otherwise(F.col("corrected")),
    })
    known = tokens.where(~F.coalesce("unknown_form", F.lit(False)))  # they stay where they are: no shuffle
    return fixed.select(*tokens.columns).unionByName(known)
