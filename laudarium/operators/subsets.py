"""Overlapping subsets of sections by attribute and date range, and weighted samples of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INDEXED = ("book_title", "convent_location", "palatinate")


def ranges(date_ranges: DataFrame) -> DataFrame:
    """(range_n, start, end), the end not included, from d-m-yyyy."""
    day = lambda c: F.try_to_date(F.col(c), "d-M-yyyy")
    return date_ranges.select("range_n", day("range_start").alias("start"), day("range_end").alias("end"))


def attribute_keys(attributes: Sequence[str] = INDEXED):
    """ALL, and attribute__value of each attribute; a null value is written None."""
    return F.array(F.lit("ALL"), *[F.concat(F.lit(f"{a}__"), F.coalesce(F.col(a), F.lit("None"))) for a in attributes])


def by_attribute(rows: DataFrame, attributes: Sequence[str] = INDEXED) -> DataFrame:
    """Each row once for every attribute subset it is in."""
    return rows.withColumn("subset", F.explode(attribute_keys(attributes)))


def subset_index(found: DataFrame, date_ranges: DataFrame, attributes: Sequence[str] = INDEXED) -> DataFrame:
    """(subset, section_id): ALL, every attribute's value, and every date range that holds the section's date.

    Ranges meet sections by the years that they touch, and then by comparison of dates; an undated section is
    in no range.
    """
    of_attributes = by_attribute(found, attributes).select("subset", "section_id")
    span = ranges(date_ranges).where("start is not null and end is not null and start < end")
    of_years = span.withColumn("_year", F.explode(F.sequence(F.year("start"), F.year("end"))))
    near = found.where("date is not null").select("section_id", "date", F.year("date").alias("_year")).join(of_years, "_year")
    dated = near.where((F.col("date") >= F.col("start")) & (F.col("date") < F.col("end")))
    return of_attributes.unionByName(dated.select(F.concat(F.lit("date_range__"), "start", F.lit("_"), "end").alias("subset"), "section_id"))


def sampling_key(seed: int):
    """The order that stands for a shuffle: the same on every engine with MD5."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col("section_id").cast("string")).cast("binary"))


def weighted_sample(found: DataFrame, weights: DataFrame, value: str = "palatinate", seed: int = 1) -> DataFrame:
    """(value, section_id, text_length, quota): sections drawn until each value's share of the text follows its weight.

    The value with the least text for its weight (coverage, at most 100) scales the whole. Sections are taken
    in hash order while what was taken before is under the quota, so the last may exceed it. Values without
    weight, and weights without sections, are left out; null values, too.

    The running sum goes over 256 ranges of the hash first and then within a range, so that no value is one
    task's work.
    """
    weight = weights.where(F.col(value).isNotNull()).groupBy(value).agg(F.max("weight").alias("weight"))
    rows = found.join(weight, value).select(F.col(value).alias("value"), "section_id", "text_length", "weight").withColumn("key", sampling_key(seed)).withColumn("part", F.substring("key", 1, 2))
    observed = rows.groupBy("value").agg(F.sum("text_length").alias("observed"), F.max("weight").alias("weight"))
    totals = observed.agg(F.sum("observed").alias("total"), F.sum("weight").alias("weights"))
    shares = observed.crossJoin(F.broadcast(totals))  # one row
    least = shares.agg(F.least(F.lit(100.0), F.min((F.col("observed") / F.col("total")) / (F.col("weight") / F.col("weights")))).alias("coverage"))
    quotas = shares.crossJoin(F.broadcast(least)).select("value", (F.col("weight") / F.col("weights") * (F.col("coverage") * F.col("total"))).alias("quota"))
    parts = rows.groupBy("value", "part").agg(F.sum("text_length").alias("size"))
    earlier = F.coalesce(F.sum("size").over(Window.partitionBy("value").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("text_length").over(Window.partitionBy("value", "part").orderBy("key", "section_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        rows.join(parts.select("value", "part", earlier.alias("earlier")), ["value", "part"])
        .withColumn("before", F.col("earlier") + within)
        .join(quotas, "value").where("before < quota")
        .select("value", "section_id", "text_length", F.round("quota", 6).alias("quota"))
    )
