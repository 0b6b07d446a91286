from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from laudarium.functions import classify
from laudarium.operators import loader

KINDS = [
    "Laudum sejmiku ziemi halickiej 1590 roku w Haliczu", "my rady i rycerstwo wszystkie ziemi halickiej, na ten czas zebrani", "Uchwaliliśmy zgodnie pobór łanowy na obronę granic Rzeczypospolitej, który to pobór wybierać będzie poborca nasz " * 3,
    "Rp. 12 k. 3", "zob. str. 5", "i tak dalej aż do końca sprawy naszej na tym sejmiku", "Instrukcja posłom na sejm walny z Wiszni 1603",
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(k,) for k in KINDS], "t string")
    rows = df.select("t", classify.meta_reason(F.col("t")).alias("m"), classify.heading_score(F.col("t")).alias("h"), classify.beginning_score(F.col("t")).alias("b"), F.length("t").alias("n")).collect()
    return {r.t: r for r in rows}


def _walk(texts, scored):
    """The sections of one edition, step by step."""
    sections, doc, notes, waiting = [], [], [], None
    for t in texts:
        if scored[t].m is not None:
            notes.append(t)
            continue
        if waiting is not None:
            if scored[waiting].h + max(0, scored[t].b) > 0:
                if doc:
                    sections += [("document", doc), *[("meta", [n]) for n in notes]]
                    notes = []
                doc = [waiting]
            else:
                doc.append(waiting)
        waiting = t
    if waiting is not None:
        doc.append(waiting)
    if doc:
        sections += [("document", doc), *[("meta", [n]) for n in notes]]
    return sections


def _merged(sections):
    out, fold = [], False
    for kind, pars in sections:
        if kind == "document":
            short = len(pars) == 1 or len("\n\n".join(pars)) < 250
            if fold:
                next(s for s in reversed(out) if s[0] == "document")[1].extend(pars)
            else:
                out.append((kind, list(pars)))
            fold = short
        else:
            out.append((kind, list(pars)))
    return out


def _got(df):
    by = {}
    for r in sorted(df.collect(), key=lambda r: (r.edition, r.section_n, r.page_n, r.par_n)):
        by.setdefault(r.edition, {}).setdefault(r.section_n, (r.section_type, []))[1].append(r.text)
    return {e: [s[k] for k in sorted(s)] for e, s in by.items()}


@pytest.mark.parametrize("blocks", [(32, 4096), (1, 2)])
def test_documents_are_those_of_a_walk_through_the_edition(spark, scored, monkeypatch, blocks):
    monkeypatch.setattr(loader, "PAGES", blocks[0])
    monkeypatch.setattr(loader, "SECTIONS", blocks[1])
    rng = random.Random(1)
    editions = {f"e{k}": [rng.choice(KINDS) for _ in range(rng.randint(1, 14))] for k in range(60)}
    rows = [(e, i // 4, i, t) for e, ts in editions.items() for i, t in enumerate(ts)]
    seg = loader.segment(spark.createDataFrame(rows, "edition string, page_n int, par_n int, text string"))
    walked = {e: _walk(ts, scored) for e, ts in editions.items()}
    repaired = lambda s: [(k, [x.strip() for x in p]) for k, p in s]
    got = _got(seg)
    for e, want in walked.items():
        assert repaired(got.get(e, [])) == repaired(want), e
    merged = _got(loader.merge_short(seg))
    for e, want in walked.items():
        assert repaired(merged.get(e, [])) == repaired(_merged(want)), e


def test_pages_to_paragraphs(spark):
    pages = spark.createDataFrame([("e", "x-003.txt", 0, "ala ma kota i psa w domu\nkrótki\ndalej idzie ten sam tekst\n\n  \n\nrn i koniec strony drugiej"), ("e", "x-010.txt", 1, "pominięta"), ("e", "x-011.txt", 2, None)], "edition string, file_name string, page_n int, text string")
    kept = loader.without_pages(pages, [(10, 11)])
    assert [r.file_name for r in kept.orderBy("page_n").collect()] == ["x-003.txt", "x-011.txt"]
    got = [(r.page_n, r.par_n, r.text) for r in loader.page_paragraphs(kept, 10).orderBy("page_n", "par_n").collect()]
    assert got == [(0, 1, "ala ma kota i psa w domu\nkrótki"), (0, 2, "dalej idzie ten sam tekst"), (0, 3, "m i koniec strony drugiej")]
    assert loader.page_paragraphs(kept).count() == 2


def test_islands_and_numbers(spark):
    df = spark.createDataFrame([("b", i, k) for i, k in enumerate([1, 1, 2, 1, None, None, 2])], "book string, i int, k int")
    for size in (2, 4096):
        assert [r.island_n for r in loader.islands(df, ["book"], "i", "k", size).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 4]
    s = spark.createDataFrame([("e", n, t) for n, t in enumerate(["document", "meta", "document"])], "edition string, section_n int, section_type string")
    assert [(r.inbook_section_id, r.inbook_document_id) for r in loader.renumber(s).orderBy("section_n").collect()] == [(0, 0), (1, None), (2, 1)]


def test_one_book_of_nearly_all_rows_is_many_tasks(spark, monkeypatch):
    """Of 9,000 paragraphs, 90 % of one book, windows over rows go over blocks, and only those over blocks go over the edition."""
    windows, plain = [], loader.written

    def recorded(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows.extend(line.split("windowspecdefinition", 1)[1].split("specifiedwindowframe")[0] for line in plan.splitlines() if " Window " in line)
        return plain(df, name)

    monkeypatch.setattr(loader, "written", recorded)
    rows = [("hot" if i % 10 else "cold", i // 20, i, "Laudum sejmiku ziemi halickiej 1590 roku w Haliczu" if i % 50 == 1 else "i tak dalej aż do końca sprawy naszej na tym sejmiku") for i in range(9000)]
    found = loader.segment(spark.createDataFrame(rows, "edition string, page_n int, par_n int, text string"))
    assert found.count() == 9000 and loader.merge_short(found).count() == 9000
    assert len(windows) > 6 and all("_block" in w for w in windows)


def test_paragraphs_without_edition_page_or_text(spark):
    rows = [("e", None, 1, KINDS[0]), ("e", 1, 2, KINDS[1]), ("e", 1, 3, None), (None, 1, 1, KINDS[0])]
    got = loader.segment(spark.createDataFrame(rows, "edition string, page_n int, par_n int, text string")).collect()
    assert {r.edition for r in got} == {"e"} and len(got) == 3
    assert loader.segment(spark.createDataFrame([], "edition string, page_n int, par_n int, text string")).count() == 0
