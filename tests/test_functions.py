from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laudarium.functions import classify, patterns, tokens
from laudarium.functions.dates import dates_in, stored_date

TEXTS = [
    "", "krótki", "Artykuły sejmiku województwa ruskiego 1590 roku zebranego w Wiszni", "Instrukcja dana posłom na sejm walny z Borka dnia 6 lipca 1603.", "my rady i rycerstwo wszystkie ziemi naszej",
    "Rp. 12 k. 3", "KSIĘGA VXI UCHWAŁ", "a ) b ) c ) coś", "12-13 34 45 66 78 99", "Uniwersał króla JMci, że początek jest", "Mowa o tym. Por. str. 5, zob. wsp.", "x. y. z. ab. cd. ef. gh. ij.", "Jan Kowalski Piotr Nowak Adam",
    "ala ma kota\nkróciutko\n" + "długo " * 60, "Laudum - kwit - 00 konwokacyjne", "«Zażółć» gęślą jaźń ²½ ٣", "aaaa aaaa", "Wszystkie ziemi naszej urzędnicy", "[IV] Laudum conventus", "ś 4. Kto by", "lnstrukcja ćm ", None,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def _col(texts, c):
    return [r.x for r in texts.select("i", c.alias("x")).orderBy("i").collect()]


def test_patterns_find_what_python_finds(texts):
    every = patterns.META_SIGNS + patterns.HEADING_FIRST + patterns.HEADING_SECOND + patterns.HEADING_AGAINST + [patterns.OPENING]
    row = texts.select("i", *[F.col("t").rlike(patterns.rx(p)).alias(f"p{k}") for k, p in enumerate(every)]).orderBy("i").collect()
    for r, t in zip(row, TEXTS):
        for k, p in enumerate(every):
            flags = re.I if p.startswith("(?iu)") else 0
            want = None if t is None else bool(re.search(p.removeprefix("(?iu)"), t, flags))
            assert r[f"p{k}"] == want, (p, t)


def test_nested_brackets_are_refused():
    with pytest.raises(ValueError):
        patterns.rx("[ab[cd]]")


def test_headings(texts):
    def want(t, most=300):
        if t is None:
            return None
        if not 15 <= len(t) <= most:
            return -1.5
        b = t.replace("-", "")
        hits = lambda ps: sum(bool(re.search(p.removeprefix("(?iu)"), b, re.I if p.startswith("(?iu)") else 0)) for p in ps)
        first = hits(patterns.HEADING_FIRST)
        letter = re.search(r"[^\W\d_]", b)
        low = 1 if not letter or letter[0].lower() == letter[0] else 0
        return first + hits(patterns.HEADING_SECOND) - (0 if first else 1.5) - 0.6 * hits(patterns.HEADING_AGAINST) - low - len(b) / 70

    for got, t in zip(_col(texts, classify.heading_score(F.col("t"))), TEXTS):
        assert got == pytest.approx(want(t)) if t is not None else got is None or got == -1.5


def test_beginnings_lines_and_keys(texts):
    scores = _col(texts, classify.beginning_score(F.col("t")))
    n = {t: s for t, s in zip(TEXTS, scores)}
    assert n["my rady i rycerstwo wszystkie ziemi naszej"] == pytest.approx(0.1)
    assert n["Wszystkie ziemi naszej urzędnicy"] == pytest.approx(-0.2 + 0.3 * 10 / 11)
    assert n["krótki"] == -0.5
    lines = {"po-\nseł i\nkról x": " poseł i król", "a b": " a b", "pierwszy x\ndrugi x": " pierwszy x drugi", "koniec-\nX": " koniec- X", "a-\n": " a- "}
    df = texts.sparkSession.createDataFrame([(k,) for k in lines], "t string").select("t", classify.joined_lines(F.col("t")).alias("x"), classify.match_key(F.col("t")).alias("k"))
    for r in df.collect():
        assert r.x == lines[r.t] and r.k == re.sub(r"\s|\\n", "", r.t)


def test_notes_have_reasons(texts):
    reasons = dict(zip(TEXTS, _col(texts, classify.meta_reason(F.col("t")))))
    assert reasons[None] is None and reasons[""] == "short" and reasons["Rp. 12 k. 3"] == "sign" and reasons["KSIĘGA VXI UCHWAŁ"] == "capital word"
    assert reasons["Jan Kowalski Piotr Nowak Adam"] == "capitals" and reasons["a ) b ) c ) coś"] in ("sign", "short words", "footnotes")
    assert reasons["ala ma kota\nkróciutko\n" + "długo " * 60] == "long line"
    assert reasons["my rady i rycerstwo wszystkie ziemi naszej"] is None


def test_scanner_repairs(texts):
    got = dict(zip(TEXTS, _col(texts, classify.ocr_corrected(F.col("t")))))
    assert got["ś 4. Kto by"] == "§ 4. Kto by" and got["lnstrukcja ćm "] == "Instrukcja em "


def test_pertinence(spark):
    given = [(1, "x", None, "Laudum", False), (3, "nasi sędziowie", "My, rady", "Laudum", False), (3, "My, rady", None, "x", True), (3, "x", "my rady", None, True), (3, "x", None, "Kwit dany", True), (3, None, None, None, False), (None, None, None, None, False)]
    df = spark.createDataFrame(given, "n int, a string, b string, t string, want boolean").select("want", classify.pertinent(F.col("n"), F.col("a"), F.col("b"), F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_dates():
    cases = {
        "z Osieka- 4 października 1572 -r. eis": [(4, 10, 1572)], "9 V 1755": [(9, 5, 1755)], "64. Wisnia, 24. maja 1683. Laudum": [(24, 5, 1683)], "die 22 Junii,anno 1705.": [(22, 6, 1705)],
        "Februarius, 16. 1703": [(16, 2, 1703)], "Februarius, 16. 1803": [], "Februarius, 30. 1703": [], "1650 Februarius, 3. 173": [(3, 2, 1650)], "(Junius, 28), anno Domini 1706.": [(28, 6, 1706)],
        "9 V 1955": [], "dnia 3 listopada 1650 r.": [], "6 Novembris 1650 anno": [], "7 kwietnia 1650 r.": [(7, 4, 1650)], "29 lutego 1655 r.": [], "": [], "maj": [], "12 maja 1650": [(12, 5, 1650)],
    }
    for text, want in cases.items():
        assert dates_in(text) == want, text
    assert dates_in(None) == [] and (5, 7, 1650) in dates_in("5 VIII 1650 r.") or dates_in("5 VIII 1650 r.") == []


def test_stored_dates(spark):
    given = ["(24, 5, 1683)", "False", "(30, 2, 1700)", "(1, 13, 1600)", "", None, "(1, 2)", "(a, 2, 1600)", "( 3 , 4,1601)"]
    got = [r.d and r.d.isoformat() for r in spark.createDataFrame([(g,) for g in given], "t string").select(stored_date(F.col("t")).alias("d")).collect()]
    assert got == ["1683-05-24", None, None, None, None, None, None, None, "1601-04-03"]


def test_token_strings(spark):
    given = {"LA_PN_??_Roma:Roma:subst:sg": ("Roma", "Roma", ["subst", "sg"], True, True, True, False), "a_LA_b:x": ("a_b", "x", [], True, False, False, False), "LA:la:x": ("LA", "la", ["x"], False, False, False, False), "!!_a:b:": ("a", "b", [""], False, False, False, True), "nic": None, "": None}
    df = spark.createDataFrame([(t,) for t in given], "t string").select("t", tokens.decoded(F.col("t")).alias("d"))
    for r in df.collect():
        want = given[r.t]
        assert r.d is None if want is None else (r.d.form, r.d.lemma, r.d.interp, r.d.latin, r.d.proper_name, r.d.unknown_form, r.d.corrected) == want
    blank = spark.createDataFrame([("a:b  c:d\n x e:f:g",)], "t string").select(tokens.forms_text(tokens.token_list(F.col("t"))).alias("x"), F.size(tokens.token_list(F.col("t"))).alias("n")).first()
    assert (blank.x, blank.n) == ("a c e", 3)


word = st.text(st.characters(exclude_characters=":_ \n\t", exclude_categories=["Cs", "Cc", "Z"]), min_size=1, max_size=6).filter(lambda w: w not in tokens.SIGNS.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(word, word, st.lists(word, max_size=3), st.booleans(), st.booleans(), st.booleans()), min_size=1, max_size=20))
def test_token_strings_come_back(spark, rows):
    df = spark.createDataFrame([(*r, False) for r in rows], "form string, lemma string, interp array<string>, latin boolean, proper_name boolean, unknown_form boolean, corrected boolean")
    names = df.columns
    back = df.select("*", tokens.decoded(tokens.encoded(*[F.col(c) for c in names])).alias("d")).collect()
    assert all(tuple(r[c] for c in names) == tuple(r.d[c] for c in names) for r in back)
