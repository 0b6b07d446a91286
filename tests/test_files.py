from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F
from pyspark.sql import types as T

from laudarium import editions
from laudarium.operators.loader import islands
from laudarium.sinks import files as sinks
from laudarium.sinks import tei
from laudarium.sources import files, html


def test_an_edition_comes_back(spark, tmp_path):
    rows = [("Księga, t. 1", str(k // 2), "0", str(k), "document", "(1, 2, 1600)", "p", "c", "False", 'a "b"', f'tekst, "cytat"\nlinia {k}', "True") for k in range(5)]
    df = spark.createDataFrame(rows, files.INDEXED).coalesce(1)
    sinks.indexed_csv(df, str(tmp_path / "e"))
    back = files.indexed_csv(spark, str(tmp_path / "e"))
    assert sorted(tuple(str(x) for x in r) for r in back.select(*sinks.INDEXED).collect()) == sorted(rows)
    assert back.where("document_number = 0 and pertinent").count() == 5
    assert [r.island_n for r in islands(back, ["file"], "place", "inbook_section_id").orderBy("place").collect()] == [0, 0, 1, 1, 2]
    assert files.editions([back.drop("file"), back.limit(1)]).groupBy("edition_ord").count().count() == 2


def test_an_edition_of_several_files_comes_back(spark, tmp_path):
    """Forty sections over four files, cut where sections go on: every section is whole, in order, with all its paragraphs."""
    rows = [("Księga, t. 1", str(k % 20), "0", str(k), "document", "False", "p", "c", "False", "a", f"{k} akapit {n}\nlinia", "True", k, n) for k in range(40) for n in range(1, 6)]
    df = spark.createDataFrame(rows, T.StructType([*files.INDEXED.fields, T.StructField("section_id", T.IntegerType()), T.StructField("par_n", T.IntegerType())]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.indexed_csv(df.repartition(7, "paragraph"), str(tmp_path / "e"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "e").glob("*.csv"))) == 4
    back = editions.paragraphs(spark, str(tmp_path / "e"), 3)
    got = [(r.section_n, r.par_n, r.inbook_section_id, r.paragraph) for r in back.orderBy("section_id", "par_n").collect()]
    assert got == [(k, n, k % 20, f"{k} akapit {n}\nlinia") for k in range(40) for n in range(1, 6)]
    sinks.indexed_csv(back, str(tmp_path / "again"))
    again = editions.paragraphs(spark, str(tmp_path / "again"), 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, back.collect()))


def test_pages_keywords_dictionaries(spark, tmp_path):
    for name, text in (("v-002.txt", "dwa"), ("v-001.txt", "jeden\n\nakapit"), ("w-001.txt", "nie")):
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / name).write_text(text)
    assert [(r.file_name, r.page_n, r.text) for r in files.pages(spark, str(tmp_path / "p"), "v-").orderBy("page_n").collect()] == [("v-001.txt", 0, "jeden\n\nakapit"), ("v-002.txt", 1, "dwa")]
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "law.txt").write_text("sąd  sędzia\nprawo\n")
    (tmp_path / "k" / "_dump.txt").write_text("x\n")
    assert sorted(map(tuple, files.keyword_files(spark, str(tmp_path / "k")).collect())) == [("law", 0, 0, "sąd"), ("law", 0, 1, "sędzia"), ("law", 1, 0, "prawo")]
    d = spark.createDataFrame([("a", ["x", "y"])], "form string, interps array<string>")
    sinks.dictionary(d, str(tmp_path / "d"))
    assert [tuple(r) for r in files.dictionary(spark, str(tmp_path / "d")).collect()] == [("a", ["x", "y"])]
    sinks.results(spark.createDataFrame([("ALL", "a", 2), ("p__x", "b", 1)], "subset string, lemma string, n int"), str(tmp_path / "r"))
    assert (tmp_path / "r" / "subset=ALL").is_dir()
    sinks.document_ids(spark.createDataFrame([(0, "T", True, "document"), (1, "N", False, "meta")], "inbook_document_id int, title string, pertinence boolean, section_type string"), str(tmp_path / "i"))
    assert spark.read.csv(str(tmp_path / "i")).count() == 1


def _sections(spark, text, structure, **kw):
    got = html.sections(spark.createDataFrame([("e", text), ("n", None)], "edition string, html string"), structure, **kw).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.section_n, r.par_n)):
        by.setdefault((r.section_n, r.section_type), []).append(r.text)
    return [(kind, pars) for (_, kind), pars in sorted(by.items())]


def test_html_structures(spark):
    body = "my rady i rycerstwo wszystkie ziemi halickiej na ten czas zebrani"
    page = f"<html><head><title>x</title></head><body><p>przed <b>uwaga</b></p><ol><li>Pierwszy</li></ol><p>{body}</p><p>krótki</p><script>var a = '</p>';</script><ol><li>Drugi</li></ol><p lang=x><span lang='ru-RU'>рус</span></p><p>{body}</p></body></html>"
    assert _sections(spark, page, "nowogr") == [("meta", ["przed uwaga"]), ("meta", ["krótki"]), ("document", ["Pierwszy", body]), ("meta", ["рус"]), ("document", ["Drugi", body])]
    assert ("meta", ["рус"]) not in _sections(spark, page, "nowogr", strip_ruthenian=True)
    page = "<body><p>wstęp</p><p><i>Wstęp 1</i></p><p><i>1. Tytuł 1590</i></p><p>tekst &amp; dalej</p><p><b>nota</b></p><div>nic</div><p><i>2. Tytuł 1600</i></p><p>x</p></body>"
    assert _sections(spark, page, "generic_doc") == [("meta", ["wstęp"]), ("meta", ["Wstęp 1"]), ("meta", ["nota"]), ("document", ["1. Tytuł 1590", "tekst & dalej"]), ("document", ["2. Tytuł 1600", "x"])]
    title = "Laudum sejmiku ziemi chełmskiej 1590 roku"
    page = f"<body><p align=center><b>{title}</b></p><p>tekst</p><p><font>nota</font></p><p align=center><b>nic</b></p><ol><i>{title}</i></ol><p>x</p></body>"
    assert _sections(spark, page, "chelmskie_doc") == [("meta", ["nota"]), ("meta", ["nic"]), ("document", [title, "tekst"]), ("document", [title, "x"])]
    page = "<body><a name=1></a>strona zero<hr><a name=2></a>nagłówek<i>1. Tytuł</i>tekst<i>nota</i><hr>dalej<i>2. Tytuł</i></body>"
    assert _sections(spark, page, "wlkp_pdf") == [("meta", ["nagłówek"]), ("document", ["strona zero"]), ("meta", ["nota"]), ("document", ["1. Tytuł", "tekst", "dalej"]), ("document", ["2. Tytuł"])]


def test_reports_and_tei(spark):
    s = spark.createDataFrame([("e", 0, "meta", None, "sign", ["a<b\nc"]), ("e", 1, "document", "T & t", None, ["p1", "p2"])], "edition string, section_n int, section_type string, title string, reason string, paragraphs array<string>")
    got = [r.html for r in sinks.html_report(s).orderBy("section_n").collect()]
    assert "a&lt;b<br>c" in got[0] and "<em>sign</em>" in got[0] and got[1] == "<h4>T &amp; t</h4><p>p1</p><p>p2</p>"
    interp = [("a", "subst", "sg:nom"), ("a", "subst", "sg:acc"), ("b", "adj", "pl")]
    token = lambda w, o: (w, o, interp)
    parsed = [[[token("Ala", 0), token("ma", 4), token(".", 6)]], [[token("x", 0)]]]
    schema = "book_title string, section_n int, section_type string, document_id int, title string, date string, convent_location string, paragraphs array<struct<page:int,text:string>>, parsed array<array<array<struct<orth:string,offset:int,interps:array<struct<base:string,ctag:string,msd:string>>>>>>"
    rows = [("B", 0, "document", 0, "Ala ma.", "1600-01-02", "c", [(5, "Ala ma."), (6, "x")], parsed), ("B", 1, "meta", None, None, None, "c", [(6, "nota")], None), ("B", 2, "document", 1, "", None, "c", [], None)]
    config = {"default_convent_author": "sejmik x", "page_num_shift": 10, "authors": {"0:::Ala ma.": "marszałek"}, "publication_info": {"editor": "E", "place": "P", "year": 1900}}
    out = {r.path: ET.fromstring(r.xml) for r in tei.corpus_files(spark.createDataFrame(rows, schema), config, "corp").collect()}
    assert sorted(out) == ["corp/corp-0/ann_morphosyntax.xml", "corp/corp-0/ann_segmentation.xml", "corp/corp-0/header.xml", "corp/corp-0/text.xml", "corp/note_2/header.xml", "corp/note_2/text.xml"]
    assert out["corp/corp-0/header.xml"].find(".//{*}author").text == "marszałek" and out["corp/corp-0/header.xml"].find(".//{*}biblScope").text == "15-16"
    assert [pb.get("n") for pb in out["corp/corp-0/text.xml"].iter(f"{{{tei.TEI}}}pb")] == ["15", "16"] and out["corp/note_2/text.xml"].find(".//{*}note").text == "nota"
    segs = list(out["corp/corp-0/ann_segmentation.xml"].iter(f"{{{tei.TEI}}}seg"))
    assert [s.get(f"{{{tei.NKJP}}}nps") for s in segs] == [None, None, "true", None] and segs[2].get("corresp") == "text.xml#string-range(txt_1.1-ab,6,1)"
    lex = out["corp/corp-0/ann_morphosyntax.xml"].find(".//{*}f[@name='interps']")
    assert len(lex) == 2 and len(list(lex.iter(f"{{{tei.TEI}}}vAlt"))) == 1


def test_date_tuples(spark):
    df = spark.sql("select date'1600-02-03' as d union all select null").select(sinks.date_tuple(F.col("d")).alias("t"))
    assert {r.t for r in df.collect()} == {"(3, 2, 1600)", "False"}
