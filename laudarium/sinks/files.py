"""Results, editions, dictionaries and reports written to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEXED = ["book_title", "inbook_section_id", "inbook_document_id", "scan_page", "section_type", "section_date", "palatinate", "convent_location", "created_location", "author", "paragraph", "pertinence"]


def date_tuple(date):
    """A date as (d, m, y), no date as False: how editions keep it."""
    return F.when(date.isNull(), "False").otherwise(F.format_string("(%d, %d, %d)", F.dayofmonth(date), F.month(date), F.year(date)))


def indexed_csv(rows: DataFrame, path: str) -> None:
    """An indexed edition, a line for each paragraph, strings quoted.

    Rows are in order over all files, by name: of section_id and par_n where rows have them, else of their place, else of
    the section's number, so a section comes back whole wherever a file ends.
    """
    held = set(rows.columns)
    number = F.col("inbook_section_id").try_cast("int")
    order = ["section_id", "par_n"] if {"section_id", "par_n"} <= held else ["place"] if "place" in held else ["book_title", number, *(["par_n"] if "par_n" in held else [])]
    rows.orderBy(*order).select(*INDEXED).write.csv(path, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def results(found: DataFrame, path: str, by: tuple[str, ...] = ("subset",)) -> None:
    """One folder for each subset (and whatever else tells results apart), tab-delimited."""
    found.write.partitionBy(*by).option("delimiter", "\t").csv(path)


def dictionary(entries: DataFrame, path: str) -> None:
    entries.select("form", "interps").write.json(path)


def document_ids(sections: DataFrame, path: str) -> None:
    """(document id, title, pertinence, empty) of documents, as CSV."""
    sections.where("section_type = 'document'").select("inbook_document_id", "title", "pertinence", F.lit("").alias("note")).write.csv(path, quote='"', escape='"')


def html_report(sections: DataFrame) -> DataFrame:
    """(edition, section_n, html): notes highlighted, with the reason why they are notes; documents with their titles.

    sections has edition, section_n, section_type, title, reason and paragraphs, an array of texts.
    """
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>"))
    shade = '<p style="background-color: moccasin'
    note = F.concat(F.lit(shade + '; font-family: monospace">'), safe(F.get("paragraphs", F.lit(0))), F.lit("</p>" + shade + '"><em>'), F.coalesce("reason", F.lit("")), F.lit("</em></p>"))
    body = F.array_join(F.transform("paragraphs", lambda p: F.concat(F.lit("<p>"), safe(p), F.lit("</p>"))), "")
    document = F.concat(F.lit("<h4>"), safe(F.coalesce("title", F.lit(""))), F.lit("</h4>"), body)
    return sections.select("edition", "section_n", F.when(F.col("section_type") == "meta", note).otherwise(document).alias("html"))


def save_texts(files: DataFrame, folder: str, content: str) -> None:
    """Each row (path, content) as a file below a folder that all executors share; a row's file is written whole, then renamed."""

    def write(rows) -> None:
        import os

        for row in rows:
            target = os.path.join(folder, row["path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target + ".part", "w", encoding="utf-8") as f:
                f.write(row[content] or "")
            os.replace(target + ".part", target)

    files.select("path", content).foreachPartition(write)
