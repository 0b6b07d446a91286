from __future__ import annotations

import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from laudarium.llm import langid
from laudarium.llm.hyper import fitted, word_vector, words
from laudarium.llm.sentences import sentence_starts
from laudarium.session import table

PL = "Szlachta ziemi naszej uchwaliła pobór łanowy na sejmiku dla całości Rzeczypospolitej."
LA = "Nobilitas huius terrae decrevit contributionem publicam cum consensu omnium ordinum."
UK = "Шляхта землі нашої ухвалила новий податок на сеймику для добра посполитого."


def test_labels(spark):
    given = [("pl", ["pl"]), ("PL", ["pl"]), ("lat-x", ["la"]), ("la+pol", ["la", "pl"]), ("und", []), ("", []), (None, []), ("?", []), ("deu+DE", ["de"]), ("UKR + zho", ["uk", "zh"])]
    df = spark.createDataFrame([(a,) for a, _ in given], "label string").select(langid.label_names(F.col("label")).alias("n"))
    assert [r.n for r in df.collect()] == [b for _, b in given]


@pytest.fixture
def small(spark, rows):
    given = [(k, 2, t) for k, t in enumerate([PL, LA, UK] * 8)] + [(50, 2, f"{PL} {LA}"), (51, 2, PL), (52, 2, None), (53, 2, ""), (54, 2, "12 — 13"), (55, 2, "Krótko.")]
    labels = [(k, lang, None, None) for k, lang in enumerate(["pl", "la", "uk"] * 8)] + [(50, "pl", None, None), (0, "pl", None, None)]
    return rows(given), spark.createDataFrame(labels, "section_id long, lang_label string, labelled_by string, labelled_at timestamp")


def test_stretches_and_unnamed_languages(small, editions, tokens, clashing):
    rows, labels = small
    by = {}
    for r in langid.stretches(clashing(rows), labels, editions).collect():
        by.setdefault(r.section_id, []).append((r.stretch_n, r.lang, r.n_words))
        assert 0 <= r.confidence <= 1
    assert sorted(by[50]) == [(1, "pl", 11), (2, "la", 10)] and by[0][0][1] == "pl" and by[2][0][1] == "uk"
    assert 52 not in by and 53 not in by and 54 not in by
    made = tokens([(9, 1, k, w, w, None) for k, w in enumerate(LA.split())] + [(8, 1, k, w, w, True) for k, w in enumerate(LA.split())] + [(7, 1, k, w, w, True) for k, w in enumerate(PL.split())] + [(6, p, k, w, w, False) for p in range(3) for k, w in enumerate(PL.split())])
    got = {tuple(r) for r in langid.found(rows, labels, editions, made).collect()}
    assert {(50, 2, "la"), (51, 2, "pl")} <= got and not {g for g in got if g[0] < 6 or g[0] in (52, 53, 54, 55, 8, 6)}
    assert (9, 1, "la") in got


def test_nothing(small, rows, spark, editions, tokens):
    _, labels = small
    assert langid.stretches(rows([]), labels, editions).count() == 0
    assert langid.token_paragraphs(tokens([])).count() == 0
    assert langid.stretches(rows([(1, 2, PL)]), labels.limit(0), editions).count() >= 0


#: Words that stand in one of the languages alone: what a text is, without any profile.
ONLY = {"pl": "i w na z nie się do że jest są przez oraz", "la": "et cum quod non ad est atque per quae sunt ut eius", "de": "und der die das nicht ist mit von den wird zu auf", "fr": "les des est une dans pour qui que du au sur avec"}


def _held_out(spark, sf_dir):
    """(sample, texts) as (language, sentence): sections of even hash are the sample, with labels as they are given; of the others the language is that of their small words, and none that is also in the sample is taken."""
    rows, labels, editions = (table(spark, sf_dir, t) for t in ("edition_rows", "section_labels", "editions"))
    text = langid.plain_text(rows, editions)
    named = labels.select("section_id", langid.label_names(F.col("lang_label")).alias("n")).where(F.size("n") == 1).select("section_id", F.col("n")[0].alias("lang"))
    sample, texts, seen = [], [], set()
    for r in text.join(named, "section_id", "left").withColumn("even", F.pmod(F.xxhash64("section_id"), F.lit(2)) == 0).orderBy("section_id", "par_n").collect():
        starts = sentence_starts(r["text"])
        said = [r["text"][a:b] for a, b in zip(starts, [*starts[1:], len(r["text"])])]
        if r["even"] and r["lang"]:
            sample += [(r["lang"], x) for x in said]
            seen.update(said)
        elif not r["even"]:
            texts += said
    small = {w: k for k, ws in ONLY.items() for w in ws.split()}
    out = []
    for x in texts:
        n = Counter(small[w] for w in words(x) if w in small)
        if x not in seen and len(words(x)) >= langid.STRETCH and sum(n.values()) >= 2 and len(n) == 1:
            out.append((n.most_common(1)[0][0], x))
    return sample, out


def _right(profiles, texts):
    by = defaultdict(list)
    for lang, x in texts:
        by[lang].append(profiles.languages[int(profiles.cosines(profiles.rows(words(x)).sum(axis=0), len(words(x))).argmax())] == lang)
    return {k: (sum(v) / len(v), len(v)) for k, v in by.items()}


def test_accuracy_by_language_on_texts_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test data here")
    sample, texts = _held_out(spark, sf_dir)
    for whiten in (True, False):
        of = _right(fitted(sample, langid.LANGUAGES, whiten=whiten), texts)
        print(whiten, of)
        assert set(of) == set(ONLY) and all(n >= 20 for _, n in of.values())
        assert not whiten or min(r for r, _ in of.values()) > 0.97
    p = fitted(sample, langid.LANGUAGES)
    assert np.allclose(np.linalg.norm(p.own, axis=1), 1)
    off = []
    for _, text in texts[:: max(1, len(texts) // 80)]:  # the length of a text is estimated
        x = sum(word_vector(w).astype(float) for w in words(text))
        off.append(np.abs(p.cosines(p.rows(words(text)).sum(axis=0), len(words(text))) - p.own @ x / np.linalg.norm(x)).max())
    assert np.median(off) < 0.06 and max(off) < 0.2


def test_held_out_accuracy(spark, sf_dir):
    """Texts in scripts of their own show what is right; the labels that profiles are made of are wrong in part."""
    rows, labels, editions = (table(spark, sf_dir, t) for t in ("edition_rows", "section_labels", "editions"))
    script = lambda p: F.length(F.regexp_replace("paragraph", f"[^{p}]", "")) > 0.5 * F.length("paragraph")
    truth = rows.select("section_id", "par_n", F.when(script("Ѐ-ӿ"), "uk").when(script("Ա-և"), "hy").when(script("一-鿿"), "zh").alias("truth")).where("truth is not null").distinct()
    main = langid.stretches(rows, labels, editions).groupBy("section_id", "par_n").agg(F.max_by("lang", "n_words").alias("lang"))
    r = truth.join(main, ["section_id", "par_n"]).agg(F.avg((F.col("truth") == F.col("lang")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 20 and r.right > 0.97
