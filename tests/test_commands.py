from __future__ import annotations

import json
import xml.etree.ElementTree as ET

from laudarium.__main__ import main
from laudarium.sinks import files as sinks
from laudarium.sinks.tei import TEI
from laudarium.sources import files

TITLE, BODY = "Laudum sejmiku ziemi halickiej w Haliczu dnia 4 maja 1590 roku", "my rady i rycerstwo wszystkie ziemi halickiej, zgodnie uchwaliliśmy pobór łanowy na obronę granic " * 4


def engine():
    """Every word in small letters as its lemma; a sentence for each text."""
    return lambda text: [[(w, w.lower(), ["subst", "sg"]) for w in text.split()]]


def forms():
    return lambda lemma: [lemma, lemma + "i"]


def _csv(path):
    return {p.name: p for p in path.iterdir() if p.suffix == ".csv"}


def test_pages_become_an_edition(spark, tmp_path, capsys):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "x-001.txt").write_text(f"{TITLE}\n\n{BODY}\n\nRp. 12 k. 3 zob. str. 5")
    (tmp_path / "pages" / "x-002.txt").write_text(f"{TITLE.replace('1590', '1591')}\n\n{BODY}")
    config = {"path": str(tmp_path / "pages"), "prefix": "x-", "max_nonmeta_line_len": 2000, "max_heading_len": 300, "book_title": "B", "palatinate": "p", "convent_location": "c", "default_convent_author": "sejmik", "dev__true_document_pages": [0, 1, 2], "authors": {}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    main(["load", str(tmp_path / "c.json"), str(tmp_path / "e")])
    rows = files.indexed_csv(spark, str(tmp_path / "e"))
    got = sorted((r.inbook_section_id, r.section_type, r.section_date, r.pertinence, r.paragraph[:6]) for r in rows.collect())
    assert got == [(0, "document", "(4, 5, 1590)", "True", "Laudum"), (0, "document", "(4, 5, 1590)", "True", "my rad"), (1, "meta", "False", "False", "Rp. 12"), (2, "document", "(4, 5, 1591)", "True", "Laudum"), (2, "document", "(4, 5, 1591)", "True", "my rad")]
    main(["score", str(tmp_path / "c.json"), str(tmp_path / "e")])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["difference"] == 0
    main(["ids", str(tmp_path / "e"), str(tmp_path / "ids")])
    assert spark.read.csv(str(tmp_path / "ids")).count() == 2
    main(["tei", str(tmp_path / "c.json"), str(tmp_path / "e"), str(tmp_path / "tei")])
    assert sorted(p.parent.name for p in (tmp_path / "tei").rglob("text.xml")) == ["corpus-0", "corpus-1", "note_2"]
    main(["tag", str(tmp_path / "e"), str(tmp_path / "t"), "--engine", "tests.test_commands:engine"])
    tagged = files.indexed_csv(spark, str(tmp_path / "t")).orderBy("place").collect()
    assert len(tagged) == 5 and tagged[0].paragraph.startswith("Laudum:laudum:subst:sg sejmiku:") and tagged[0].paragraph.endswith("\n") and tagged[2].paragraph.startswith("Rp. 12")
    main(["tag", str(tmp_path / "e"), str(tmp_path / "t2"), "--engine", "tests.test_commands:engine", "--strip-meta", "--start-section", "1"])
    assert [r.inbook_section_id for r in files.indexed_csv(spark, str(tmp_path / "t2")).collect()] == [2, 2]
    main(["tei", str(tmp_path / "c.json"), str(tmp_path / "e"), str(tmp_path / "tei2"), "--tagged", str(tmp_path / "t")])
    segm = ET.parse(tmp_path / "tei2" / "corpus" / "corpus-0" / "ann_segmentation.xml").getroot()
    assert segm.tag == f"{{{TEI}}}teiCorpus" and len(segm.findall(".//{*}p")) == 2 and segm.find(".//{*}w").text == "Laudum" and segm.find(".//{*}seg").get("corresp") == "text.xml#string-range(txt_1.1-ab,0,6)"
    morph = ET.parse(tmp_path / "tei2" / "corpus" / "corpus-0" / "ann_morphosyntax.xml").getroot()
    assert morph.find(".//{*}symbol").get("value") == "subst"
    main(["html", str(tmp_path / "e"), str(tmp_path / "html")])
    assert spark.read.text(str(tmp_path / "html")).count() == 3


def test_methods_over_a_tagged_edition(spark, tmp_path, capsys):
    text = "pan:pan:subst król:król:subst ??_paz:paz:subst itd.:i:brev " * 3
    rows = [("B", "0", "0", "1", "document", "(1, 2, 1600)", "p", "c", "False", "a", "Tytuł:tytuł:subst", "True"), ("B", "0", "0", "1", "document", "(1, 2, 1600)", "p", "c", "False", "a", text, "True"), ("B", "1", "False", "2", "meta", "False", "p", "c", "False", "a", "x:x:y", "False")]
    sinks.indexed_csv(spark.createDataFrame(rows, files.INDEXED).coalesce(1), str(tmp_path / "e"))
    (tmp_path / "list").write_text("e\n")
    (tmp_path / "kw").mkdir()
    (tmp_path / "kw" / "law.txt").write_text("król pan\n")
    (tmp_path / "r.json").write_text(json.dumps([["1-1-1590", "1-1-1610"]]))
    (tmp_path / "w.json").write_text(json.dumps({"p": 2.0}))
    main(["run", str(tmp_path / "list"), str(tmp_path / "out"), "--keywords", str(tmp_path / "kw"), "--ranges", str(tmp_path / "r.json"), "--weights", str(tmp_path / "w.json")])
    lemmas = spark.read.option("delimiter", "\t").csv(str(tmp_path / "out" / "lemma_frequency")).collect()
    assert {(r.subset, r._c0, r._c1) for r in lemmas if r.subset.startswith(("ALL", "date"))} == {(s, w, "3") for s in ("ALL", "date_range__1590-01-01_1610-01-01") for w in ("pan", "król", "paz")}
    assert (tmp_path / "out" / "group_years" / "subset=ALL" / "keyword_group=law_król").is_dir()
    main(["search", str(tmp_path / "list"), "pan", "RE:^kr", "DR:1-1-1600:1-1-1601"])
    assert capsys.readouterr().out.splitlines()[-1] == "3 matches found."
    main(["search", str(tmp_path / "list"), "pan", "DR:1-1-1601:1-1-1602"])
    assert capsys.readouterr().out.splitlines()[-1] == "0 matches found."
    main(["dictionary", str(tmp_path / "list"), str(tmp_path / "d")])
    main(["correct", str(tmp_path / "e"), str(tmp_path / "d"), str(tmp_path / "fixed")])
    fixed = [r.paragraph for r in files.indexed_csv(spark, str(tmp_path / "fixed")).where("inbook_section_id = 0").collect()]
    assert any("!!_pan:paz:subst" in p for p in fixed)


def test_ngrams_of_every_subset(spark):
    from laudarium.operators import collocations

    given = [(s, 2, n, w, ["ALL", f"book_title__{b}"]) for s, b, text in ((1, "a", "pan król pan król"), (2, "b", "pan sąd"), (3, "a", "pan król")) for n, w in enumerate(text.split())]
    tokens = spark.createDataFrame(given, "section_id long, par_n int, tok_n int, lemma string, subsets array<string>")
    got = {(r.subset, r.w1_lemma, r.w2_lemma, r.n) for r in collocations.collocations(tokens, ["lemma"], 2, by_subset=True).collect()}
    assert got == {("ALL", "pan", "król", 3), ("book_title__a", "pan", "król", 3), ("book_title__a", "król", "pan", 2), ("ALL", "król", "pan", 2)}


def test_decisions_of_every_kind_are_made_while_loading(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "x-001.txt").write_text(f"{TITLE}\n\n{BODY}")
    (tmp_path / "pages" / "x-002.txt").write_text(f"{TITLE.replace('1590', '1591')}\n\n{BODY}")
    config = {"path": str(tmp_path / "pages"), "prefix": "x-", "max_nonmeta_line_len": 2000, "max_heading_len": 300, "book_title": "B"}
    (tmp_path / "c.json").write_text(json.dumps(config))
    second = TITLE.replace("1590", "1591")
    made = [
        {"decision_type": "date", "pagenum": 0, "from_title": TITLE, "date": [1, 2, 1600]}, {"decision_type": "title_form", "pagenum": 0, "from_title": TITLE, "to_title": "Nowy tytuł"},
        {"decision_type": "pertinence", "pagenum": 0, "from_title": TITLE, "pertinence_status": False}, {"decision_type": "type", "pagenum": 1, "from_title": second, "section_type": "meta"},
    ]
    (tmp_path / "d.json").write_text(json.dumps(made))
    main(["load", str(tmp_path / "c.json"), str(tmp_path / "e"), "--decisions", str(tmp_path / "d.json")])
    got = [(r.inbook_section_id, r.inbook_document_id, r.section_type, r.section_date, r.pertinence, r.paragraph[:10]) for r in files.indexed_csv(spark, str(tmp_path / "e")).orderBy("place").collect()]
    assert got == [(0, "0", "document", "(1, 2, 1600)", "False", "Nowy tytuł"), (0, "0", "document", "(1, 2, 1600)", "False", BODY[:10]), (1, "False", "meta", "False", "False", TITLE[:10]), (1, "False", "meta", "False", "False", BODY[:10])]


def test_lists(spark, tmp_path, capsys):
    (tmp_path / "l.txt").write_text("rex lex\nrex\n")
    main(["decline", str(tmp_path / "l.txt"), str(tmp_path / "d"), "--engine", "tests.test_commands:forms"])
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).orderBy("value").collect()] == ["lex lexi", "rex rexi"]
    (tmp_path / "f.txt").write_text("pan 5 0.5\nkról 3 0.3\nsąd 2 0.2\n")
    for lines, total in ((2, 8), (9, 10)):
        main(["sumhead", str(tmp_path / "f.txt"), str(lines)])
        assert capsys.readouterr().out.splitlines()[-1] == str(total)


def test_positions_of_graphs(spark):
    from laudarium.operators import lattice

    graphs = {1: ([(1, 2), (2, 3)], [1]), 2: ([(1, 2), (1, 4), (2, 3), (3, 5), (4, 5)], [1]), 3: ([(1, 3), (2, 3), (3, 4), (3, 5)], [1, 2])}
    edges = spark.createDataFrame([(g, a, b) for g, (es, _) in graphs.items() for a, b in es], "sent long, from_token int, to_token int")
    starts = spark.createDataFrame([(g, t) for g, (_, ts) in graphs.items() for t in ts], "sent long, token int")
    got = {}
    for r in lattice.path_positions(lattice.all_paths(edges, starts)).orderBy("sent", "position_n").collect():
        got.setdefault(r.sent, []).append(r.alternatives)
    assert got == {1: [[[1]], [[2]], [[3]]], 2: [[[1]], [[2, 3], [4]], [[5]]], 3: [[[1], [2]], [[3]], [[4], [5]]]}
