from __future__ import annotations

import random

from laudarium.llm import chunking
from laudarium.llm.chunking import JOIN, MOST, OVERLAP, cut, found, pieces


def _text(rng):
    out = []
    for _ in range(rng.randint(1, 10)):
        size = rng.choice([0, 1, 30, 400, MOST - 1, MOST, MOST + 1, 5000, 7000, rng.randint(0, 3000)])
        if rng.random() < 0.2:
            out.append("x" * size)
            continue
        p = ""
        while len(p) < size:
            p += "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) + rng.choice([" ", ". ", "  ", "\n"])
        out.append(p[:size])
    return out


def _level(paragraphs):
    if any(len(w) > MOST for p in paragraphs for w in p.split()):
        return "unbroken"
    return "within" if max(map(len, paragraphs)) > MOST else "paragraph"


def test_pieces_cover_the_text_within_the_limit():
    rng = random.Random(1)
    for _ in range(400):
        paragraphs = _text(rng)
        before = rng.choice(["", "tail of what was " * 20 + JOIN])
        text, at, last = JOIN.join(paragraphs), 0, None
        for begin, start, end, _ in cut(paragraphs, before):
            assert end - begin <= MOST and begin <= start and not text[at:start].strip()
            if last is not None:
                assert last - begin <= OVERLAP
            at = last = end
        assert not text[at:].strip()
        kinds = {k for *_, k in cut(paragraphs, before)}
        if len(text) > MOST:
            assert _level(paragraphs) == ("unbroken" if 3 in kinds else "within" if kinds & {1, 2} else "paragraph")


def test_an_edit_alters_only_near_pieces():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(9000)]
    one, two = list(words), list(words)
    two[4000] = "edited"
    texts = lambda w: {t[s:e] for t in [" ".join(w)] for _, s, e, _ in cut([t])}
    a, b = texts(one), texts(two)
    assert len(a) > 15 and len(a - b) <= 4


def test_sections_of_rows(rows, clashing, monkeypatch):
    rng = random.Random(3)
    given, want = [], {}
    for s in range(12):
        paragraphs = _text(rng)
        given += [(s, n, p) for n, p in enumerate(paragraphs, 1)]
        if len(JOIN.join(paragraphs)) > MOST:
            want[s] = _level(paragraphs)
    given += given[:5] + [(None, 1, "x" * 9000), (50, 1, None), (51, 1, ""), (52, None, "y" * 3000)]
    want[52] = "unbroken"
    for group, longest, places in ((256, 1024, 4096), (2, 3, 4)):
        monkeypatch.setattr(chunking, "GROUP_PARAGRAPHS", group)
        monkeypatch.setattr(chunking, "LONGEST_GROUP", longest)
        monkeypatch.setattr(chunking, "PLACES", places)
        df = clashing(rows(given))
        assert {r.section_id: r.cut_level for r in found(df).collect()} == want
        by = {}
        for r in sorted(pieces(df).collect(), key=lambda r: (r.section_id, r.piece_n)):
            by.setdefault(r.section_id, []).append(r)
        for s, own in by.items():
            text = JOIN.join(p for x, n, p in sorted({g for g in given if g[0] == s and g[1] is not None}, key=lambda g: g[1])) if s != 52 else "y" * 3000
            assert [r.piece_n for r in own] == list(range(1, len(own) + 1))
            at = 0
            for r in own:
                assert len(r.piece) <= MOST and r.piece[r.overlap :] == text[r.char_start : r.char_end] and not text[at : r.char_start].strip()
                at = r.char_end
            assert not text[at:].strip()


def test_a_paragraph_more_alters_only_near_pieces(rows):
    """Also where groups end, and in whatever task a paragraph was: 1,200 paragraphs, one more at the start, in the middle and near the end."""
    rng = random.Random(4)
    said = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 80))) + "." for _ in range(1200)]
    of = lambda paragraphs: [r.piece[r.overlap :] for r in pieces(rows([(1, n, p) for n, p in enumerate(paragraphs, 1)])).orderBy("piece_n").collect()]
    plain = of(said)
    assert len(plain) > 120
    for at in (0, 600, 1190):
        more = of([*said[:at], "Jeden akapit więcej.", *said[at:]])
        assert len(set(more) - set(plain)) <= 3


def test_paragraphs_that_are_all_alike_are_still_many_groups(rows, spark):
    text = spark.range(1, 5001).selectExpr("1L as section_id", "id as place", "'same' as paragraph")
    groups = chunking._grouped(text).orderBy("group_n").collect()
    assert max(len(g.paragraphs) for g in groups) <= chunking.LONGEST_GROUP and sum(len(g.paragraphs) for g in groups) == 5000


def test_rows_without_place_come_first(rows):
    given = [(1, None, f"bez miejsca {k} " + "x" * 200) for k in range(40)] + [(1, k, f"akapit {k} " + "y" * 200) for k in range(1, 30)]
    got = pieces(rows(given)).orderBy("piece_n").collect()
    text = "".join(r.piece[r.overlap :] for r in got)
    assert max(text.index(p) for _, n, p in given if n is None) < min(text.index(p) for _, n, p in given if n is not None) and all(p in text for _, _, p in given)


def test_no_long_sections(rows):
    assert found(rows([])).count() == 0
    assert found(rows([(1, 1, "short")])).count() == 0


def test_sentences_and_clauses_without_blanks_are_cut_after():
    said = "城中商人收到白银29.385两，无人反对。各县代表说：“我不同意！”，随后不再说话。"
    (p,) = text = [said * 200]
    ends = [e for *_, e, _ in cut(text)]
    assert len(ends) > 3 and all(p[e - 1] == "。" for e in ends) and {k for *_, k in cut(text)[:-1]} == {chunking.SENTENCE}
    (p,) = text = ["城中商人收到白银25,2两，" * 500]
    assert all(p[e - 1] == "，" for *_, e, _ in cut(text)) and {k for *_, k in cut(text)[:-1]} == {chunking.CLAUSE}
    assert {k for *_, k in cut(["城" * 6000])[:-1]} == {chunking.NONE}


def test_a_run_with_pauses_is_still_unbroken(rows):
    assert [tuple(r) for r in found(rows([(1, 1, "众人都签了名。" * 500), (2, 1, "众人都签了名。 " * 500)])).orderBy("section_id").collect()] == [(1, "unbroken"), (2, "within")]
    assert {r.cut_kind for r in pieces(rows([(1, 1, "众人都签了名。" * 500)])).collect()} == {"sentence", "paragraph"}
