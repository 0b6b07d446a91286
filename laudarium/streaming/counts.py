"""Counts kept up to date while rows arrive: an extension, for corpora that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import words
from ..functions.dates import stored_date


def _arrived_once(rows: DataFrame, keys: list[str], late: str) -> DataFrame:
    """A row that is delivered again within `late` of its first arrival counts once; of a batch, whenever it comes."""
    timed = rows.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    return timed.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else timed.dropDuplicates(keys)


def lemma_counts(tokens: DataFrame, span: str = "30 days", late: str = "30 days") -> DataFrame:
    """(window, lemma, n) of tokens by time of arrival; a window is final once the watermark has passed it."""
    once = _arrived_once(tokens.where("lemma is not null"), ["section_id", "par_n", "tok_n", "lemma"], late)
    return once.groupBy(F.window("loaded_at", span), "lemma").agg(F.count("*").alias("n"))


def year_counts(rows: DataFrame, span: str = "30 days", late: str = "30 days") -> DataFrame:
    """(window, year, n): words of dated paragraphs, without titles, by time of arrival and year of their section."""
    dated = rows.where("par_n > 1 and paragraph is not null").withColumn("date", stored_date(F.col("section_date"))).where("date is not null")
    once = _arrived_once(dated.select("section_id", "par_n", "paragraph", "date", "loaded_at"), ["section_id", "par_n"], late)
    return once.groupBy(F.window("loaded_at", span), F.year("date").alias("year")).agg(F.sum(F.size(words(F.col("paragraph")))).cast("long").alias("n"))
