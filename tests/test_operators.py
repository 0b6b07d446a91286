from __future__ import annotations

import datetime
import math
from collections import Counter

import random

import pytest

from laudarium.operators import collocations, correction, decisions, frequency, keywords, lattice, review, score, search, subsets, tagging
from laudarium.sources import files

TOKEN = "section_id long, par_n int, tok_n int, form string, lemma string, interp array<string>, unknown_form boolean, corrected boolean"


def _tokens(spark, paragraphs):
    rows = [(s, p, k, w, w, ["subst"], w is not None and w.startswith("?"), False) for s, p, ws in paragraphs for k, w in enumerate(ws, 1)]
    return spark.createDataFrame(rows, TOKEN)


PARS = [(1, 2, "pan król pan król sejm".split()), (1, 3, ["pan"]), (2, 2, "król sejm i pan król sejm".split()), (2, 3, [None, "", "sejm"]), (3, 2, ["pan", "król"])]


def _llr(cells):
    return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0)


def test_bigrams_cross_paragraphs(spark):
    flat = [w or "" for *_, ws in PARS for w in ws]
    want = Counter(zip(flat, flat[1:]))
    one, n = Counter(flat), len(flat)
    got = {(r.w1_lemma, r.w2_lemma): r for r in collocations.collocations(_tokens(spark, PARS), ["lemma"]).collect()}
    assert {k: r.n for k, r in got.items()} == {k: v for k, v in want.items() if v >= 2 and min(map(len, k)) >= 2}
    for (a, b), r in got.items():
        k = want[a, b]
        cells = [(k, one[a] * one[b] / n), (one[b] - k, (n - one[a]) * one[b] / n), (one[a] - k, one[a] * (n - one[b]) / n), (n - one[a] - one[b] + k, (n - one[a]) * (n - one[b]) / n)]
        assert r.jaccard == pytest.approx(k / (one[a] + one[b] - k), abs=1e-6) and r.likelihood_ratio == pytest.approx(_llr(cells), abs=1e-3)
    inside = collocations.collocations(_tokens(spark, PARS), ["lemma"], boundary="paragraph").collect()
    assert {(r.w1_lemma, r.w2_lemma): r.n for r in inside} == {("pan", "król"): 4, ("król", "sejm"): 3}


def test_trigrams_and_nothing(spark):
    flat = [w or "" for *_, ws in PARS for w in ws]
    want = {k: v for k, v in Counter(zip(flat, flat[1:], flat[2:])).items() if v >= 2 and min(map(len, k)) >= 2}
    got = {(r.w1_lemma, r.w2_lemma, r.w3_lemma): r.n for r in collocations.collocations(_tokens(spark, PARS), ["lemma"], 3).collect()}
    assert got == want and got
    assert collocations.collocations(_tokens(spark, []), ["lemma"]).count() == 0


def test_keywords(spark):
    kw = spark.createDataFrame([("c", 0, 0, "król"), ("c", 0, 1, "pan"), ("c", 0, 2, "x"), ("c", 0, 3, "y"), ("c", 1, 0, "król"), ("c", 1, 1, "król")], "keyword_category string, group_n int, lemma_n int, lemma string")
    assert {r.placeholder for r in keywords.groups(kw).collect()} == {"__król-pan-x-...", "__król-król"}
    marked = keywords.with_placeholders(_tokens(spark, PARS), kw, "c")
    assert {r.lemma for r in marked.select("lemma").distinct().collect()} == {"__król-pan-x-...", "sejm", "i", "", None}
    got = {(r.w1_lemma, r.w2_lemma) for r in keywords.keyword_collocations(_tokens(spark, PARS), kw, "c", ["lemma"]).collect()}
    assert got == {("__król-pan-x-...", "__król-pan-x-..."), ("__król-pan-x-...", "sejm"), ("sejm", "__król-pan-x-...")}
    assert keywords.keyword_collocations(_tokens(spark, PARS), kw, "none", ["lemma"]).count() == collocations.collocations(_tokens(spark, PARS), ["lemma"]).count()
    counts = spark.createDataFrame([("A", "król", 5), ("A", "z", 1), ("B", "x", 2)], "subset string, lemma string, n long")
    dist = {(r.subset, r.group_n): r.group_sum for r in keywords.keyword_distribution(counts, kw).collect()}
    assert dist == {("A", 0): 5, ("A", 1): 10, ("B", 0): 2, ("B", 1): 0}
    assert [r.line for r in keywords.keyword_report(keywords.keyword_distribution(counts, kw)).where("subset = 'B'").collect()] == ["##król etc. - 2", "x - 2", "##król etc. - 0"]


def test_weighted_sample_meets_its_quotas(spark):
    rows = [(i, v, n) for i, (v, n) in enumerate([("A", 8)] * 3 + [("B", 8)] * 2 + [("C", 7)] * 3 + [(None, 9), ("X", 9)])]
    found = spark.createDataFrame(rows, "section_id long, palatinate string, text_length long")
    weights = spark.createDataFrame([("A", 3.0), ("B", 3.0), ("C", 3.0), ("D", 4.0), (None, 1.0)], "palatinate string, weight double")
    for seed in (1, 2, 3):
        got = Counter(r.value for r in subsets.weighted_sample(found, weights, seed=seed).collect())
        assert got == {"A": 2, "B": 2, "C": 3}
    assert subsets.weighted_sample(found.limit(0), weights).count() == 0


def test_subsets_overlap_and_ranges_are_half_open(spark):
    d = datetime.date
    found = spark.createDataFrame([(1, "b", None, "p", d(1572, 7, 7)), (2, None, "c", "p", None), (3, "b", "c", "q", d(1572, 7, 6))], "section_id long, book_title string, convent_location string, palatinate string, date date")
    ranges = spark.createDataFrame([(0, "1-4-1548", "7-7-1572"), (1, "1-1-1570", "1-1-1580"), (2, "x", "1-1-1580")], "range_n int, range_start string, range_end string")
    got = {(r.subset, r.section_id) for r in subsets.subset_index(found, ranges).collect()}
    assert ("ALL", 2) in got and ("book_title__None", 2) in got and ("convent_location__None", 1) in got
    assert {x for x in got if x[0].startswith("date")} == {("date_range__1548-04-01_1572-07-07", 3), ("date_range__1570-01-01_1580-01-01", 1), ("date_range__1570-01-01_1580-01-01", 3)}


def test_search(spark):
    t = _tokens(spark, PARS)
    got = {(r.section_id, r.par_n, r.tok_n): r.match for r in search.lexeme_search(t, ["pan", "RE:^kr"]).collect()}
    assert got == {(1, 2, 1): "pan król", (1, 2, 3): "pan król", (2, 2, 4): "pan król", (3, 2, 1): "pan król"}
    row = search.concordance(t, ["sejm", "i"]).first()
    assert (row.before, row.match, row.after) == ("król", "sejm i", "pan król sejm")
    assert search.lexeme_search(t, ["p.n"]).count() == 5
    assert search.date_range("DR:1-4-1548:7-7-1572") == ("1548-04-01", "1572-07-07")
    with pytest.raises(ValueError):
        search.lexeme_search(t, [])
    with pytest.raises(ValueError):
        search.date_range("DR:1-1-1500")


def test_rules_and_heads(spark):
    rules = spark.createDataFrame([(1600, "a"), (1601, "b"), (1602, "a"), (1600, "a"), (None, "a"), (1602, None)], "year int, rule string")
    assert {r.rule: (r.years, r.years_not) for r in frequency.rule_lifetimes(rules).collect()} == {"a": ([1600, 1602], [1601]), "b": ([1601], [1600, 1602])}
    assert {tuple(r) for r in frequency.rules_dropped(rules).collect()} == {(1601, "a"), (1602, "b")}
    counts = spark.createDataFrame([("x", 3), ("y", 2), ("z", 1)], "w string, n long")
    assert frequency.head_sum(counts, 2, ["w"]).first().head_sum == 5 and frequency.head_sum(counts, 9, ["w"]).first().head_sum == 6 and frequency.head_sum(counts.limit(0), 9, ["w"]).first().head_sum == 0


def test_correction(spark):
    words = spark.createDataFrame([("sejm", ["subst"]), ("sejmu", ["adj"]), ("pan", ["pan:subst"])], "form string, interps array<string>")
    t = _tokens(spark, [(1, 2, ["?ejm", "sejn", "pam", None])]).selectExpr("section_id", "par_n", "tok_n", "replace(form, '?', 's') as form", "lemma", "interp", "form is not null as unknown_form", "corrected")
    got = {r.tok_n: (r.form, r.unknown_form, r.corrected) for r in correction.correct_tokens(t, words).collect()}
    assert got[2] == ("sejm", False, True) and got[3][0] == "pan" and got[4] == (None, False, False)
    lem = {r.tok_n: (r.form, r.lemma) for r in correction.correct_tokens(t, words, use_lemmas=True).collect()}
    assert lem[3] == ("pan", "pan") and lem[2][0] == "sejm"


def test_lattices(spark):
    arcs = spark.createDataFrame([(1, 0, 1, "a", "a", "x", 0), (1, 1, 2, "b", "b", "x", 1), (1, 1, 2, "b", "c", None, 2), (1, 0, 2, "ab", "ab", "y", 3)], "sent long, start int, end int, orth string, base string, tag string, arc_n int")
    assert [(r.start, r.end, [v.base for v in r.variants]) for r in lattice.merge_variants(arcs).collect()] == [(0, 1, ["a"]), (0, 2, ["ab"]), (1, 2, ["b", "c"])]
    assert {(r.base, r.prob, r.eos) for r in lattice.weighted_arcs(arcs).collect()} == {("a", 1.0, ""), ("ab", 1.0, ""), ("b", 0.5, "eos"), ("c", 0.5, "eos")}
    places = spark.createDataFrame([(1, k, w == ".", w == "np") for k, w in enumerate(["a", ".", "np", ".", "b", "."])], "par long, pos_n int, is_stop boolean, is_brev boolean")
    assert [r.sent_n for r in lattice.split_sentences(places).orderBy("pos_n").collect()] == [0, 0, 1, 1, 1, 1]
    graphs = {1: ([(1, 2), (2, 3)], [1], [[1, 2, 3]]), 2: ([(1, 2), (1, 4), (2, 3), (3, 5), (4, 5)], [1], [[1, 2, 3, 5], [1, 4, 5]]), 3: ([(1, 3), (2, 3), (3, 4), (3, 5)], [1, 2], [[1, 3, 4], [1, 3, 5], [2, 3, 4], [2, 3, 5]])}
    edges = spark.createDataFrame([(s, a, b) for s, (e, *_) in graphs.items() for a, b in e], "sent long, from_token int, to_token int")
    starts = spark.createDataFrame([(s, x) for s, (_, f, _) in graphs.items() for x in f], "sent long, token int")
    by = {}
    for r in sorted(lattice.all_paths(edges, starts).collect(), key=lambda r: (r.sent, r.path_n)):
        by.setdefault(r.sent, []).append(r.path)
    assert by == {s: want for s, (*_, want) in graphs.items()}
    assert [lattice.positions(by[s]) for s in (1, 2, 3)] == [[1, 2, 3], [1, [[2, 3], 4], 5], [[1, 2], 3, [4, 5]]]
    lines = spark.createDataFrame([(1, 0, "0\t1\ta\ta\tsubst:sg\t\t\t\t\t\t\tdisamb"), (1, 1, "0\t1\tb\tb\tx\t\t\t\t\t\t\tdisamb"), (1, 2, "1\t2\tc\tc\tx\t\t\t\t\t\t\t"), (1, 3, "bad")], "sent long, line_n int, line string")
    assert [(r.form, r.interp) for r in lattice.tagger_rows(lines).collect()] == [("a", ["subst", "sg"])]


def test_tagging_boundary(spark):
    assert tagging.pieces("a" * 30, 10) == ["a" * 10] * 3 and tagging.pieces("", 10) == [] and all(len(p) <= 10 for p in tagging.pieces("ala ma kota i psa", 10))
    rows = spark.createDataFrame([(1, 2, "ala ma"), (1, 3, None)], "section_id long, par_n int, paragraph string")
    got = tagging.tag(rows, lambda: lambda text: [[(w, w, ["x"]) for w in text.split()]]).collect()
    assert [(r.par_n, r.tok_n, r.form) for r in got] == [(2, 0, "ala"), (2, 1, "ma")]
    assert {tuple(r) for r in tagging.expand(spark.createDataFrame([("rex",), (None,)], "lemma string"), lambda: lambda w: [w, "regis", w]).collect()} == {("rex", "rex"), ("rex", "regis")}
    raw = spark.createDataFrame([(1, 2, "ala  ma kota", ["ala", "ma", "psa", "kota"])], "section_id long, par_n int, raw string, forms array<string>")
    assert [(r.offset, r.pause) for r in tagging.transfer_spaces(raw).orderBy("tok_n").collect()] == [(0, ""), (5, "  "), (-1, ""), (8, " ")]


def _walked(found, true):
    """The distance of one way through an edition, documents as lists of numbers."""
    n, m = len(found), len(true)
    if n >= m:
        parts = [[found[0]]]
        for i in range(1, n):
            whole, goal = sum(parts[-1]), true[len(parts) - 1]
            enough = n - i - 1 >= m - len(parts)
            if len(parts) == m or (enough and abs(whole + found[i] - goal) < abs(whole - goal)):
                parts[-1].append(found[i])
            else:
                parts.append([found[i]])
        lengths = [sum(p) for p in parts]
    else:
        lengths = []
        for i, x in enumerate(found):
            rest, left = true[len(lengths) :], n - i
            shares = [x * t / sum(rest[:2]) for t in rest[:2]]
            far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
            must = len(rest) >= 2 * left
            better = i + 1 < n and len(rest) > 1 and far(shares, rest) < far([x, found[i + 1]], rest)
            lengths += shares if len(rest) > left and (must or better) else [x]
    assert len(lengths) == m
    return sum((x - y) ** 2 for x, y in zip(lengths, true)) ** 0.5


def test_scores_are_those_of_a_walk_through_each_edition(spark):
    assert score.true_lengths([1, 2, 4, 7]) == [2, 3, 4]
    rng, given, truth, want = random.Random(3), [], [], {}
    for k in range(60):
        lengths, pages = [rng.choice([0, 3, 900, rng.randint(1, 4000)]) for _ in range(rng.randint(1, 9))], [rng.randint(1, 6) for _ in range(rng.randint(1, 9))]
        given += [(f"e{k}", n, x) for n, x in enumerate(lengths)]
        truth += [(f"e{k}", n, x) for n, x in enumerate(pages)]
        scaled = [x / sum(lengths) * sum(pages) for x in lengths] if sum(lengths) else None
        known = scaled and 2 * len(lengths) >= len(pages)
        want[f"e{k}"] = (pytest.approx(min(_walked(scaled, pages), _walked(scaled[::-1], pages[::-1]))) if known else None, abs(len(lengths) - len(pages)))
    found = spark.createDataFrame([*given, ("none", 0, 5)], "edition string, document_n int, text_length long")
    got = {r.edition: (r.distance, r.difference) for r in score.indexing_scores(found, spark.createDataFrame(truth, "edition string, document_n int, pages int")).collect()}
    assert got == want
    starts = spark.createDataFrame([("a", n, p) for n, p in enumerate([1, 2, 4, 7])], "edition string, document_n int, start_page int")
    assert [r.pages for r in score.page_lengths(starts).orderBy("document_n").collect()] == [2, 3, 4]
    exact = score.indexing_scores(spark.createDataFrame([("a", n, x) for n, x in enumerate([20, 30, 40])], found.schema), score.page_lengths(starts)).first()
    assert tuple(exact) == ("a", 0.0, 0, 0.0)
    assert score.indexing_scores(found.limit(0), score.page_lengths(starts)).count() == 0


def test_decisions_and_their_log(spark, tmp_path):
    log = review.DecisionLog()
    log.pertinence("Tytuł pierwszy", 1, False)
    log.date("Tytuł  drugi", 2, 3, 5, 1600)
    log.title("Tytuł drugi", 2, "Nowy")
    log.kind("Tytuł pierwszy", 9, "meta")
    assert log.undo()["decision_type"] == "type" and log.redo()["decision_type"] == "type" and log.undo() and log.done[-1]["decision_type"] == "title_form"
    with pytest.raises(ValueError):
        log.kind("x", 1, "other")
    for name in ("d.json", "d.yaml"):
        log.write(str(tmp_path / name))
        d = files.decisions(spark, str(tmp_path / name))
        s = spark.createDataFrame([("e", 0, "Tytuł pierwszy", 1, 1, "document", None, True), ("e", 1, "Tytuł drugi", 1, 3, "document", None, True), ("e", 2, "Tytuł drugi", 5, 6, "meta", None, None)], "edition string, section_n int, title string, start_page int, end_page int, section_type string, date date, pertinence boolean")
        got = [(r.title, r.date and r.date.isoformat(), r.pertinence, r.inbook_document_id) for r in decisions.apply_decisions(s, d).orderBy("section_n").collect()]
        assert got == [("Tytuł pierwszy", None, False, 0), ("Nowy", "1600-05-03", True, 1), ("Tytuł drugi", None, None, None)]
    (tmp_path / "bad.yaml").write_text("- !!python/object:x.Y\n  a: 1\n")
    with pytest.raises(ValueError):
        files.decisions(spark, str(tmp_path / "bad.yaml"))


def test_splits_and_merges(spark, tmp_path):
    log = review.DecisionLog()
    log.split(1, "drugi dokument", "document")
    log.split(1, "uwaga", "meta")
    log.merge("dalszy ciąg", 3, "koniec", "dalszy ciąg")
    log.write(str(tmp_path / "d.json"))
    rows = [("e", 0, "document", 1, 1, "tytuł"), ("e", 0, "document", 1, 2, "koniec"), ("e", 0, "document", 1, 3, "uwaga"), ("e", 0, "document", 1, 4, "drugi dokument"), ("e", 0, "document", 2, 5, "reszta"), ("e", 1, "meta", 3, 1, "dalszy ciąg"), ("f", 0, "document", 9, 1, "inny")]
    got = decisions.replay(spark.createDataFrame(rows, decisions.PARAGRAPH), files.decisions(spark, str(tmp_path / "d.json"))).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.edition, r.section_n, r.par_n)):
        by.setdefault((r.edition, r.section_n, r.section_type), []).append(r.text)
    assert by == {("e", 0, "document"): ["tytuł", "koniec", "dalszy ciąg"], ("e", 1, "document"): ["drugi dokument", "reszta"], ("e", 2, "meta"): ["uwaga"], ("f", 0, "document"): ["inny"]}


def test_review_views(spark):
    s = spark.createDataFrame([("e", n, "document" if n % 3 else "meta", 1, 1, "x" * 90) for n in range(20)], "edition string, section_n int, section_type string, page_n int, par_n int, text string")
    assert [r.section_n for r in review.near(s, 3).collect()] == list(range(0, 8))
    assert review.preview(s, first=1).select("text").first().text == "x" * 40
    assert review.document_step(s, 5).first().section_n == 7 and review.document_step(s, 4, False).first().section_n == 2 and review.document_step(s, 19).first() is None


def test_keyword_collocations_of_every_category(spark):
    from laudarium.operators import keywords

    words = "król dać grosz sąd król dać grosz wojna król dać złoty prawo . grosz dać".split() * 2
    tokens = spark.createDataFrame([(1, 2 + n // 9, n, w, w, "x") for n, w in enumerate(words)], "section_id long, par_n int, tok_n int, form string, lemma string, tags string")
    kw = spark.createDataFrame([("money", 1, 1, "grosz"), ("money", 1, 2, "złoty"), ("law", 1, 1, "sąd"), ("law", 2, 1, "prawo"), ("war", 1, 1, "wojna"), ("war", 2, 1, "grosz")], "keyword_category string, group_n int, lemma_n int, lemma string")
    got = {tuple(r) for r in keywords.every_keyword_collocations(tokens, kw, ["form", "lemma", "tags"], 2).collect()}
    want = {(c, *r) for c in ("money", "law", "war") for r in keywords.keyword_collocations(tokens, kw, c, ["form", "lemma", "tags"], 2).collect()}
    assert got == want and {r[0] for r in got} == {"money", "law", "war"}


def test_html_report_holds_documents(spark, sf_dir):
    from laudarium.plans.registry import QUERIES

    given = {r[0] for r in spark.read.parquet(f"{sf_dir}/edition_rows.parquet").where("section_type = 'document'").select("section_id").distinct().collect()}
    html = {r.section_n: r.html for r in QUERIES["html_report"](spark, sf_dir).collect()}
    assert given and all(html[n].startswith("<h4>") for n in given)
