"""Sequences of lexemes found in paragraphs, with their context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import rx


def lexeme(pattern: str) -> str:
    """RE:x is searched for anywhere in a lemma; anything else must be all of it, its signs as they stand."""
    return rx(pattern[3:] if pattern.startswith("RE:") else f"^{pattern}$")


def date_range(argument: str) -> tuple[str, str]:
    """DR:d-m-y:d-m-y as two ISO dates, the second not included."""
    parts = argument.removeprefix("DR:").split(":")
    if len(parts) != 2:
        raise ValueError(f"not a date range: {argument}")
    return tuple("{2:04d}-{1:02d}-{0:02d}".format(*map(int, p.split("-"))) for p in parts)  # type: ignore[return-value]


def within(date: Column, argument: str) -> Column:
    """Undated rows are outside of every range."""
    low, high = date_range(argument)
    return F.coalesce((date >= F.lit(low).cast("date")) & (date < F.lit(high).cast("date")), F.lit(False))


def lexeme_search(tokens: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(section_id, par_n, tok_n, match): where consecutive tokens of a paragraph have lemmas that fit the patterns.

    Only paragraphs with a token that fits the first pattern are put in order. Null lemmas fit nothing.
    """
    if not patterns:
        raise ValueError("no lexemes given")
    fits = [F.coalesce(F.col("lemma").rlike(lexeme(p)), F.lit(False)) for p in patterns]
    order = Window.partitionBy("section_id", "par_n").orderBy("tok_n")
    marked = tokens.select("section_id", "par_n", "tok_n", "form", *[f.alias(f"f{k}") for k, f in enumerate(fits)])
    if len(patterns) == 1:
        return marked.where("f0").select("section_id", "par_n", "tok_n", F.col("form").alias("match"))
    hits = marked.where("f0").select("section_id", "par_n").distinct()
    near = marked.join(hits, ["section_id", "par_n"], "left_semi")
    follows = near
    for k in range(1, len(patterns)):
        follows = follows.withColumn(f"g{k}", F.lead(f"f{k}", k).over(order)).withColumn(f"w{k}", F.lead("form", k).over(order))
    every = F.col("f0")
    for k in range(1, len(patterns)):
        every = every & F.coalesce(F.col(f"g{k}"), F.lit(False))
    return follows.where(every).select("section_id", "par_n", "tok_n", F.concat_ws(" ", "form", *[f"w{k}" for k in range(1, len(patterns))]).alias("match"))


def concordance(tokens: DataFrame, patterns: Sequence[str], window: int | None = None) -> DataFrame:
    """(section_id, par_n, tok_n, before, match, after): each match with the forms around it, of the whole paragraph or of `window` tokens."""
    found = lexeme_search(tokens, patterns)
    around = tokens.select("section_id", "par_n", F.col("tok_n").alias("at"), "form").join(found, ["section_id", "par_n"])
    if window is not None:
        around = around.where((F.col("at") >= F.col("tok_n") - window) & (F.col("at") < F.col("tok_n") + len(patterns) + window))
    side = lambda rows: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(rows, F.struct("at", "form")))), lambda x: F.coalesce(x["form"], F.lit(""))), " ")
    return around.groupBy("section_id", "par_n", "tok_n", "match").agg(
        side(F.col("at") < F.col("tok_n")).alias("before"), side(F.col("at") >= F.col("tok_n") + len(patterns)).alias("after")
    )
