"""The tables as the operators see them: paragraphs, sections and tokens, each delivered once and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.dates import stored_date

_META = ["book_title", "inbook_section_id", "inbook_document_id", "scan_page", "section_type", "section_date", "palatinate", "convent_location", "created_location", "author", "paragraph", "pertinence"]


def paragraphs(edition_rows: DataFrame) -> DataFrame:
    """Rows of the indexed edition without copies, and the date parsed. Rows that differ in any content stay."""
    return edition_rows.select("section_id", "par_n", *_META).distinct().withColumn("date", stored_date(F.col("section_date")))


def sections(edition_rows: DataFrame) -> DataFrame:
    """A row for each section: its attributes, those of its first paragraph, its number of paragraphs and length of text.

    The text itself is not gathered: paragraphs count by sums, joined as they are by blank lines.
    """
    first = ["book_title", "section_type", "date", "palatinate", "convent_location", "author", "pertinence"]
    by = paragraphs(edition_rows).groupBy("section_id").agg(
        F.min(F.struct("par_n", *first)).alias("first"),
        F.count("*").alias("n_paragraphs"),
        (F.sum(F.length(F.coalesce("paragraph", F.lit("")))) + 2 * (F.count("*") - 1)).alias("text_length"),
    )
    return by.select("section_id", *[F.col(f"first.{c}").alias(c) for c in first], "n_paragraphs", "text_length")


def documents_only(found: DataFrame) -> DataFrame:
    """Pertinent document sections."""
    return found.where((F.col("section_type") == "document") & (F.col("pertinence") == "True"))


def tokens(parsed_tokens: DataFrame, editions: DataFrame | None = None) -> DataFrame:
    """Tagged tokens without copies (rows that differ in any content stay); with editions also the palatinate and convent_location of their books."""
    cols = ["section_id", "book_title", "par_n", "tok_n", "form", "lemma", "interp", "proper_name", "unknown_form", "latin", "corrected"]
    once = parsed_tokens.select(*cols).distinct()
    if editions is None:
        return once
    books = editions.select("book_title", "palatinate", "convent_location").dropDuplicates(["book_title"])
    return once.join(books, "book_title", "left")


def body(found: DataFrame) -> DataFrame:
    """Without titles, the first paragraphs."""
    return found.where("par_n > 1")


def unabbreviated(found: DataFrame) -> DataFrame:
    """Without tokens that are tagged as abbreviations."""
    return found.where(~F.coalesce(F.array_contains("interp", "brev"), F.lit(False)))
