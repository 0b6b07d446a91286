from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

TOKENS = "row_id long, section_id long, book_title string, par_n int, tok_n int, form string, lemma string, interp array<string>, proper_name boolean, unknown_form boolean, latin boolean, corrected boolean, loaded_at timestamp"
ROWS = "row_id long, section_id long, par_n int, book_title string, inbook_section_id int, inbook_document_id string, scan_page int, section_type string, section_date string, palatinate string, convent_location string, created_location string, author string, paragraph string, pertinence string, loaded_at timestamp"
WHEN = datetime.datetime(2024, 1, 1)


@pytest.fixture
def tokens(spark):
    """Makes tokens of (section_id, par_n, tok_n, form, lemma[, latin])."""

    def make(rows):
        full = [(i, r[0], "B", r[1], r[2], r[3], r[4], ["subst"], False, False, r[5] if len(r) > 5 else False, False, WHEN) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, TOKENS)

    return make


@pytest.fixture
def rows(spark):
    """Makes edition rows of (section_id, par_n, paragraph[, scan_page[, section_type]])."""

    def make(given, book="Akta sejmikowe ziemi Bzudosko, t. 1"):
        full = [(i, r[0], r[1], book, 0, "0", r[3] if len(r) > 3 else -1, r[4] if len(r) > 4 else "document", "False", None, None, None, None, r[2], "True", WHEN) for i, r in enumerate(given)]
        return spark.createDataFrame(full, ROWS)

    return make


@pytest.fixture
def documents(spark):
    """Makes documents of (doc_id, text[, source])."""

    def make(given):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None) for r in given]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture
def editions(spark):
    return spark.createDataFrame([("Akta sejmikowe ziemi Bzudosko, t. 1", 22)], "book_title string, page_num_shift int")


@pytest.fixture
def clashing():
    """Adds columns whose names the operators use themselves."""
    names = ["term", "n", "id", "slot", "code", "kind", "look", "exact", "size", "key", "part", "start", "end", "word", "noise", "lang", "score", "shard", "container", "title", "page", "subset"]
    return lambda df: df.withColumns({n: F.lit("x") for n in names if n not in df.columns})
