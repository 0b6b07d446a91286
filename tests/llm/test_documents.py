from __future__ import annotations

import math
import os
import random
from collections import Counter, defaultdict

import pytest

from laudarium.llm import mixing, packing
from laudarium.llm.tokenizer import VOCABULARY, cut_points, token_ids

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public tokenizer here")


def _texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["sejm", "walny", "poseł", "król", "podatek", "1703", "ziemia", "łan"]) for _ in range(rng.randint(0, 300))) for _ in range(n)]


def test_cut_points_keep_the_text_and_the_limit():
    for text in ["a b c " * 900, "x" * 5000, "王" * 3000, "", " \n" * 700, "słowo  " * 50]:
        places = cut_points(text, 100)
        assert places[0] == 0 and places[-1] == len(text) and places == sorted(places)
        assert all(len(token_ids(text[a:b])) <= 100 for a, b in zip(places, places[1:]))


def test_every_text_is_in_containers_once(documents, clashing, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 40)
    given = [(i, t) for i, t in enumerate(_texts(1, 150))] + [(900, None), (901, ""), (902, "bardzo długi tekst " * 800), (3, "drugi raz")]
    got = packing.pack(clashing(documents(given)), 512).collect()
    fill, of = defaultdict(int), defaultdict(list)
    for r in got:
        fill[r.container] += r.n_tokens
        of[r.doc_id].append(r)
    assert max(fill.values()) <= 512
    assert set(of) == {g[0] for g in given}
    long = sorted(of[902], key=lambda r: r.piece_n)
    assert [r.piece_n for r in long] == list(range(1, len(long) + 1)) and long[0].n_pieces == len(long) > 1
    assert all(a.char_end == b.char_start for a, b in zip(long, long[1:])) and long[-1].char_end == len("bardzo długi tekst " * 800)
    fits = {d for d, t in given if len(token_ids(t or "")) <= 512}
    assert all(r.n_pieces == 1 for d in fits - {3} for r in of[d]) and sum(r.piece_n == 1 for r in of[3]) == 2
    assert sum(fill.values()) / (512 * len(fill)) > 0.9


def _bm25(texts, seed):
    """Relevance of every text to a seed, straight from the formula."""
    said = [Counter(packing._TERM.findall((t or "").lower())) for t in texts]
    mean, n = sum(c.total() for c in said) / len(said), len(said)
    df = Counter(w for c in said for w in c)
    score = []
    for c in said:
        norm = packing.K1 * (1 - packing.B + packing.B * c.total() / mean)
        score.append(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (packing.K1 + 1) / (c[w] + norm) for w in said[seed] if w in c and df[w] > 1))
    return score


def test_neighbours_are_those_of_the_whole_corpus(documents, monkeypatch):
    """Recall of the ten best over 25 shards and several blocks of seeds, against the formula over all texts."""
    monkeypatch.setattr(packing, "INDEX_ITEMS", 20)
    monkeypatch.setattr(packing, "BLOCK_SEEDS", 2)
    monkeypatch.setattr(packing, "SEED_EVERY", 50)
    rng = random.Random(9)
    words = ["w" + "".join(chr(97 + int(d)) for d in str(k)) for k in range(400)]
    texts = [" ".join(rng.choice(words[: rng.choice([40, 400])]) for _ in range(rng.randint(3, 60))) for _ in range(500)]
    got = defaultdict(list)
    for r in packing.neighbours(documents(list(enumerate(texts)))).orderBy("seed_id", "rank").collect():
        got[r.seed_id].append((r.doc_id, r.score))
    assert set(got) == set(range(0, 500, 50))
    met = 0
    for seed, found in got.items():
        score = _bm25(texts, seed)
        best = sorted((d for d in range(500) if d != seed), key=lambda d: (-score[d], d))[:10]
        assert [s for _, s in found] == pytest.approx([score[d] for d, _ in found])
        met += len(set(best) & {d for d, _ in found})
    assert met / (10 * len(got)) >= 0.99


def test_the_search_copies_neither_items_nor_seeds(documents, monkeypatch):
    """However many shards and blocks there are, an item has one row, a seed as many as are asked for, and nothing is shuffled."""
    monkeypatch.setattr(packing, "INDEX_ITEMS", 20)
    monkeypatch.setattr(packing, "BLOCK_SEEDS", 2)
    monkeypatch.setattr(packing, "SEED_EVERY", 20)
    items = packing._listed(documents(list(enumerate(_texts(4, 300)))), packing.CAPACITY, VOCABULARY)
    own, near = packing._search(items, 300, None), packing._search(items, 300, 3)
    assert own.count() == own.select("item").distinct().count() > 200
    assert {r["count"] for r in near.groupBy("seed").count().collect()} == {3}
    assert not any("Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in (own, near))
    best = near.groupBy("seed").agg({"score": "max"}).count()
    assert best == items.where("doc_id % 20 = 0 and n_pieces = 1 and size(terms) > 0").count()


def test_tables_are_read_from_folders_of_any_name(spark, tmp_path):
    for name in ("plain", "zażółć %41 {a} b", "文 #1?"):
        df = spark.range(0, 50, 1, 3)
        df.write.parquet(path := (tmp_path / name).as_uri())
        got = list(packing._stored(sorted(spark.read.parquet(path).inputFiles()), ["id"], 20))
        assert [len(x) for x in got] == [20, 20, 10] and sorted(i for x in got for i in x["id"]) == list(range(50)), name


def test_a_seed_is_packed_with_its_own_texts(documents, monkeypatch):
    monkeypatch.setattr(packing, "SEED_EVERY", 10)
    monkeypatch.setattr(packing, "INDEX_ITEMS", 16)
    rng = random.Random(2)
    subject = [[f"{chr(97 + k)}{x}{y}" for x in "abcdefgh" for y in "klmnop"] for k in range(6)]
    given = [(i, " ".join(rng.choice(subject[i // 10]) for _ in range(60))) for i in range(60)]
    of = defaultdict(set)
    for r in packing.pack(documents(given), 1000).collect():
        of[r.container].add(r.doc_id)
    with_seed = [{d for d in held if d // 10 == seed // 10} for held in of.values() for seed in held if seed % 10 == 0]
    assert sum(len(own) >= 3 for own in with_seed) >= 5  # the last quarter is filled by size


def test_many_copies_are_many_tasks(documents, monkeypatch):
    """Two thirds of the texts are one text: they fall to all of its seeds, and their shards stay small."""
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    monkeypatch.setattr(packing, "SEED_EVERY", 10)
    given = [(i, "ten sam tekst zawsze" if i % 3 else f"inny tekst numer {i} oraz {i * 7}") for i in range(900)]
    got = packing.pack(documents(given), 64).collect()
    assert len(got) == 900 and {r.doc_id for r in got} == set(range(900))
    own = packing._search(packing._listed(documents(given), 64, VOCABULARY), 900, None).groupBy("seed").count().collect()
    assert max(r["count"] for r in own) < 100 and len(own) > 60


def test_packing_nothing(documents):
    assert packing.pack(documents([])).count() == 0
    assert packing.found(documents([(1, "x")])).count() == 0


def test_found_are_texts_over_the_capacity(documents):
    assert [r.doc_id for r in packing.found(documents([(1, "słowo " * 5000), (2, "słowo"), (1, None)])).collect()] == [1]


MIX = "source string, target_share double, max_repeats int"


def _mix(spark, documents, given, targets, **kw):
    return mixing.mix(documents(given), spark.createDataFrame(targets, MIX), seed=7, **kw)


def _sources(seed=6, n=400):
    rng = random.Random(5)
    return [(i, t, rng.choice(["Alfa", " alfa", "ALFA ", "beta", None, "other"])) for i, t in enumerate(_texts(seed, n))]


def _total(given, *names):
    return sum(len(token_ids(t)) for _, t, s in given if not names or (s or "").strip().lower() in names)


def test_a_mix_of_full_size_meets_its_budgets(spark, documents, clashing):
    given, targets = _sources(), [("alfa", 0.2, 1), ("beta", 0.5, 4), ("gamma", 0.3, 2)]
    records, shares = mixing.mix(clashing(documents(given)), spark.createDataFrame(targets, MIX), seed=7, size=None)
    got, by = records.collect(), {r.source: r for r in shares.collect()}
    total = _total(given)
    assert {r.source for r in got} <= {"alfa", "beta"} and len({r.doc_id for r in got}) == len(got)
    for name, share, most in targets[:2]:
        taken = sum(r.n_tokens * r.uses for r in got if r.source == name)
        assert max(r.uses for r in got if r.source == name) <= most
        assert by[name].n_tokens == taken <= by[name].budget and abs(by[name].budget - share * total) <= 1
        assert by[name].reachable == (_total(given, name) * most >= by[name].budget)
        if by[name].reachable:
            assert taken > 0.97 * by[name].budget
    assert by["gamma"].n_tokens == 0 and not by["gamma"].reachable
    assert abs(sum(r.actual_share for r in by.values()) - 1) < 1e-9
    again, _ = _mix(spark, documents, given, targets, size=None)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    missed = [r.source for r in mixing.found(documents(given), spark.createDataFrame(targets, MIX)).collect()]
    assert sorted(missed) == sorted(r.source for r in by.values() if not r.reachable)


def test_a_feasible_mix_meets_its_shares(spark, documents):
    given, targets = _sources(8, 900), [("alfa", 0.2, 1), ("beta", 0.7, 2), ("other", 0.1, 1)]
    records, shares = _mix(spark, documents, given, targets)
    by = {r.source: r for r in shares.collect()}
    most = min(_total(given, n) * k / share for n, share, k in targets)
    for name, share, k in targets:
        assert by[name].reachable and abs(by[name].actual_share - share) < 0.005 and abs(by[name].share_of_size - share) < 0.005
        assert by[name].mix_size == by[name].feasible_size == int(most) and max(r.uses for r in records.where(f"source = '{name}'").collect()) <= k
    twice = _mix(spark, documents, [(1, "a b c", "alfa"), (1, "a b c", "alfa"), (1, "d", "alfa")], [("alfa", 1.0, 1)])[0].collect()
    assert len(twice) == 3
    smaller = {r.source: r for r in _mix(spark, documents, given, targets, size=9000)[1].collect()}
    assert {r.mix_size for r in smaller.values()} == {9000} and smaller["beta"].budget == 6300 >= smaller["beta"].n_tokens > 6000


def test_mixing_nothing(spark, documents):
    for size in ("feasible", None):
        records, shares = _mix(spark, documents, [], [("alfa", 1.0, 2)], size=size)
        assert records.count() == 0 and [(r.source, r.n_tokens) for r in shares.collect()] == [("alfa", 0)]
        records, shares = _mix(spark, documents, [(1, None, "alfa"), (2, "x", None)], [("alfa", 1.0, None), (None, 0.5, 1)], size=size)
        assert records.count() == 0 and shares.count() == 1
