"""Pages to sections: paragraphs, notes, headings, documents.

Every operator takes paragraphs with edition, page_n and par_n. What depends on the order of an edition is carried
on over blocks of its pages first and within a block then, so a book of any length is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import beginning_score, heading_score, meta_reason, ocr_corrected
from ..numbering import carry
from ..session import written

SHORT = 250
#: Pages, and sections, of an edition that one task looks through.
PAGES, SECTIONS = 32, 4096


def without_pages(pages: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Pages whose file number is in none of the half-open ranges; the number is that between - and . of the name."""
    number = F.split(F.try_element_at(F.split("file_name", "-"), F.lit(2)), r"\.")[0].try_cast("int")
    out = pages
    for a, b in ranges:
        out = out.where(~F.coalesce((number >= a) & (number < b), F.lit(False)))
    return out


def page_paragraphs(pages: DataFrame, shortest_line: int | None = None) -> DataFrame:
    """(edition, page_n, par_n, text): pages split at blank lines and, with shortest_line, after every shorter line; trimmed, repaired, empty ones left out."""
    blocks = pages.select("edition", "page_n", F.posexplode(F.split("text", "\n\n")).alias("block_n", "block"))
    if shortest_line is not None:
        lines = F.split("block", "\n")
        step = lambda acc, line: F.struct(
            F.when(F.length(line) < shortest_line, F.concat(acc["done"], F.array(F.concat_ws("\n", acc["open"], F.array(line))))).otherwise(acc["done"]).alias("done"),
            F.when(F.length(line) < shortest_line, F.array().cast("array<string>")).otherwise(F.concat(acc["open"], F.array(line))).alias("open"),
        )
        start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"))
        parts = F.aggregate(lines, start, step, lambda acc: F.concat(acc["done"], F.when(F.size(acc["open"]) > 0, F.array(F.array_join(acc["open"], "\n"))).otherwise(F.array().cast("array<string>"))))
        blocks = blocks.select("edition", "page_n", "block_n", F.posexplode(parts).alias("part_n", "block"))
    else:
        blocks = blocks.withColumn("part_n", F.lit(0))
    clean = blocks.select("edition", "page_n", "block_n", "part_n", F.regexp_replace(ocr_corrected(F.col("block")), r"^(?U)\s+|(?U)\s+$", "").alias("text")).where("text <> ''")
    order = Window.partitionBy("edition", "page_n").orderBy("block_n", "part_n")
    return clean.select("edition", "page_n", F.row_number().over(order).alias("par_n"), "text")


def segment(paragraphs: DataFrame, max_line: int = 200, max_heading: int = 300, discount: float = 70) -> DataFrame:
    """(edition, section_n, section_type, page_n, par_n, text): notes and documents in their order.

    A paragraph that is no note is a title if its heading score, and the beginning score of the next one that
    is no note if that is above 0, are together above 0; the last one of an edition is none. Documents begin
    at titles. A note comes after the document that was open when it stood, in the order of commits: a
    document is committed at the paragraph after the title of the next. An edition of notes alone gives nothing;
    nor do paragraphs without an edition.
    """
    text, keys, order = F.col("text"), ["edition"], ["page_n", "par_n"]
    block = F.floor(F.coalesce("page_n", F.lit(-1)) / PAGES)
    scored = paragraphs.where("edition is not null").select("edition", "page_n", "par_n", "text", F.coalesce(meta_reason(text, max_line).isNotNull(), F.lit(False)).alias("meta"), heading_score(text, max_heading, discount).alias("score"), beginning_score(text).alias("begin"))
    plain = lambda c: F.when(~F.col("meta"), c)  # noqa: E731 - what looks before or behind looks past the notes
    seen = carry(written(scored, "scored"), keys, block, order, before={"earlier": plain(F.lit(1))}, after={"next": plain(F.col("begin"))})
    title = plain(F.col("next").isNotNull() & F.coalesce(F.col("score") + F.greatest(F.lit(0.0), "next") > 0, F.lit(False)))
    titled = seen.withColumn("title", title).withColumn("begins", F.coalesce("title", F.lit(False)) & F.col("earlier").isNotNull())
    opened = carry(written(titled.select("edition", "page_n", "par_n", "text", "meta", "title", "begins"), "titled"), keys, block, order, before={"opened": plain(F.col("begins"))}, upto={"document_n": F.col("begins").cast("int")})
    committing = opened.withColumn("commits", ~F.col("meta") & F.coalesce("opened", F.lit(False)))
    placed = carry(written(committing, "opened"), keys, block, order, earlier={"committed": F.col("commits").cast("int"), "notes": F.col("meta").cast("int")})
    placed = written(placed, "placed")
    # a document stands behind the documents before it and the notes before its commit, a note behind the documents committed by then and the notes before it
    before = placed.where("commits").select("edition", (F.col("committed") + 1).alias("document_n"), F.col("notes").alias("notes_before"))
    some = placed.where("not meta").select("edition").distinct()
    section = F.when(F.col("meta"), F.col("committed") + 1 + F.col("notes")).otherwise(F.col("document_n") + F.coalesce("notes_before", F.lit(0)))
    out = placed.join(before, ["edition", "document_n"], "left").join(some, "edition", "left_semi")
    return out.select(
        "edition", section.cast("int").alias("section_n"), F.when(F.col("meta"), "meta").otherwise("document").alias("section_type"), "page_n", "par_n",
        F.when(F.col("title"), ocr_corrected(F.trim(ocr_corrected(text)))).otherwise(text).alias("text"),
    )


def merge_short(sections: DataFrame) -> DataFrame:
    """Sections of segment() where a document after a short one (one paragraph, or under 250 characters) is part of the nearest earlier document that stays.

    Whether a document is short depends on its own paragraphs alone. Numbers stay those before the merge.
    """
    sizes = written(sections.where("section_type = 'document'").groupBy("edition", "section_n").agg(F.count("*").alias("n"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("size")), "sizes")
    block, order = F.floor(F.col("section_n") / SECTIONS), ["section_n"]
    after = carry(sizes, ["edition"], block, order, before={"short": (F.col("n") == 1) | (F.col("size") < SHORT)}).withColumn("gone", F.coalesce("short", F.lit(False)))
    kept = carry(written(after, "short"), ["edition"], block, order, before={"earlier": F.when(~F.col("gone"), F.col("section_n"))})
    into = kept.select("edition", "section_n", F.when(F.col("gone"), F.col("earlier")).otherwise(F.col("section_n")).alias("into"))
    return sections.join(into, ["edition", "section_n"], "left").withColumn("section_n", F.coalesce("into", "section_n")).drop("into")


def numbered(sections: DataFrame) -> DataFrame:
    """Sections (edition, section_n, section_type, ...) with inbook_section_id from 0 and inbook_document_id, null for notes."""
    document = F.coalesce(F.col("section_type") == "document", F.lit(False))
    counted = carry(written(sections, "sections"), ["edition"], F.floor(F.col("section_n") / SECTIONS), ["section_n"], earlier={"inbook_section_id": F.lit(1), "inbook_document_id": document.cast("int")})
    return counted.withColumns({"inbook_section_id": F.col("inbook_section_id").cast("int"), "inbook_document_id": F.when(document, F.col("inbook_document_id")).cast("int")})


def renumber(sections: DataFrame) -> DataFrame:
    """inbook_section_id from 0 over all sections of an edition, inbook_document_id over its documents (null for notes)."""
    return numbered(sections.select("edition", "section_n", "section_type").distinct()).select("edition", "section_n", "section_type", "inbook_section_id", "inbook_document_id")


def islands(rows: DataFrame, partition: Sequence[str], order: str, key: str, size: int = 4096) -> DataFrame:
    """rows with island_n, counted from 0: consecutive rows of a partition (not null) with the same key, null being one, are one island.

    order is a column of whole numbers, different in each row of a partition; a task has so many as `size` of them.
    """
    block = F.floor(F.col(order) / size)
    seen = carry(written(rows.select(*partition, order, key), "keys"), partition, block, [order], before={"_last": F.struct(key)})
    new = F.col("_last").isNull() | ~F.col(key).eqNullSafe(F.col("_last")[key])
    counted = carry(written(seen.select(*partition, order, new.cast("int").alias("_new")), "new"), partition, block, [order], upto={"island_n": F.col("_new")})
    return rows.join(counted.select(*partition, order, (F.col("island_n") - 1).cast("int").alias("island_n")), [*partition, order])


def load_edition(pages: DataFrame, ignore: Sequence[tuple[int, int]] = (), shortest_line: int | None = None, max_line: int = 200, max_heading: int = 300, discount: float = 70) -> DataFrame:
    """Pages (edition, file_name, page_n, text) to sections, without manual decisions."""
    return merge_short(segment(page_paragraphs(without_pages(pages, ignore), shortest_line), max_line, max_heading, discount))
