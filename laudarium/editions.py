"""Indexed editions in files, as the tables that the operators take."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import stored_date
from .functions.tokens import token_list
from .operators.decisions import apply_decisions
from .operators.loader import islands
from .session import written
from .sources import files

_SECTION_BITS = 32


def paragraphs(spark: SparkSession, path: str, ordinal: int = 0) -> DataFrame:
    """Rows of one edition with section_id and par_n: consecutive rows with one section number are a section.

    section_id holds the edition's ordinal and the place of the section; par_n counts from 1.
    """
    raw = files.indexed_csv(spark, path).withColumn("edition_ord", F.lit(ordinal))
    marked = written(islands(raw, ["edition_ord"], "place", "inbook_section_id"), "edition")
    section = F.shiftleft(F.lit(ordinal).cast("long"), _SECTION_BITS) + F.col("island_n")
    begins = marked.groupBy("island_n").agg(F.min("place").alias("_begin"))
    return (
        marked.join(begins, "island_n")
        .withColumn("section_id", section).withColumn("par_n", (F.col("place") - F.col("_begin") + 1).cast("int")).withColumn("date", stored_date(F.col("section_date")))
        .select("section_id", "edition_ord", F.col("island_n").alias("section_n"), "par_n", *[c for c in files.INDEXED.names], "date")
    )


def sections(rows: DataFrame) -> DataFrame:
    """A row for each section: its attributes, title (the first paragraph), pages, number of paragraphs and length."""
    first = ["edition_ord", "section_n", "book_title", "section_type", "date", "palatinate", "convent_location", "author", "pertinence", "paragraph", "scan_page"]
    by = rows.groupBy("section_id").agg(
        F.min(F.struct("par_n", *first)).alias("f"), F.max(F.struct("par_n", "scan_page")).alias("l"), F.count("*").alias("n_paragraphs"),
        (F.sum(F.length(F.coalesce("paragraph", F.lit("")))) + 2 * (F.count("*") - 1)).alias("text_length"),
    )
    plain = [F.col(f"f.{c}").alias(c) for c in first if c not in ("paragraph", "scan_page")]
    return by.select("section_id", *plain, F.col("f.paragraph").alias("title"), F.col("f.scan_page").cast("int").alias("start_page"), F.col("l.scan_page").cast("int").alias("end_page"), "n_paragraphs", "text_length")


def listed(spark: SparkSession, list_path: str) -> tuple[DataFrame, DataFrame]:
    """(sections, paragraphs) of a list of editions, each line a CSV path and, optionally, a file of decisions and a config.

    Decisions are applied; pertinent documents remain. Paths are relative to the list.
    """
    base, rows, every = os.path.dirname(os.path.abspath(list_path)), None, None
    with open(list_path, encoding="utf-8") as f:
        lines = [line.split() for line in f if line.strip()]
    for ordinal, fields in enumerate(lines):
        at = [os.path.join(base, x) for x in fields]
        own = paragraphs(spark, at[0], ordinal)
        found = sections(own).withColumn("edition", F.lit(str(ordinal))).withColumn("pertinence", F.col("pertinence") == "True")
        if len(at) > 1:
            found = apply_decisions(found, files.decisions(spark, at[1])).drop("inbook_section_id", "inbook_document_id")
        rows = own if rows is None else rows.unionByName(own)
        every = found if every is None else every.unionByName(found)
    if every is None:
        raise ValueError("the list names no edition")
    kept = every.where((F.col("section_type") == "document") & F.col("pertinence"))
    return kept, rows.join(kept.select("section_id"), "section_id", "left_semi")


def tokens(rows: DataFrame) -> DataFrame:
    """Tagged paragraphs as tokens; what is no token is left out."""
    each = rows.select("section_id", "book_title", "palatinate", "convent_location", "date", "par_n", F.posexplode(token_list(F.col("paragraph"))).alias("k", "t"))
    return each.select("section_id", "book_title", "palatinate", "convent_location", "date", "par_n", (F.col("k") + 1).alias("tok_n"), "t.*")
