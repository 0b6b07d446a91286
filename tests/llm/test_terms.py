from __future__ import annotations

import itertools
import random
import unicodedata
from collections import Counter, defaultdict

from laudarium.llm import cooccurrence, frequency


def _term(w):
    return None if w is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", w.strip()).lower()) or None


def _random_tokens(seed, sections=40):
    rng = random.Random(seed)
    words = ["Rok", "rok", " rok", "życie", "życie", "Życie ", "i", ",", None, "", "sejm", "Łan", "łan", "poseł"] + [f"w{k}" for k in range(30)]
    rows = []
    for s in range(sections):
        for p in range(1, rng.randint(1, 3) + 1):
            for t in range(1, rng.randint(1, 12) + 1):
                rows.append((s if rng.random() > 0.02 else None, p, t, rng.choice(words), rng.choice(words)))
    return rows + rng.sample(rows, len(rows) // 5)


def test_term_frequency_is_that_of_brute_force(tokens, clashing):
    given = _random_tokens(1)
    found = {(r.term_field, r.term): (r.n_tokens, r.n_sections, r.use_class) for r in frequency.term_frequency(clashing(tokens(given))).collect()}
    n, held, every = Counter(), defaultdict(set), {r[0] for r in given} - {None}
    for s, _, _, form, lemma in set(given):
        for field, word in (("form", form), ("lemma", lemma)):
            if _term(word):
                n[field, _term(word)] += 1
                held[field, _term(word)] |= {s} - {None}
    want = {}
    for k in n:
        d = len(held[k])
        want[k] = (n[k], d, "rare" if d < 3 else "common" if 5 * d >= 2 * len(every) else "useful")
    assert found == want


def test_light_terms_are_counted_as_heavy_ones(tokens, monkeypatch):
    given = _random_tokens(2)
    all_heavy = sorted(map(tuple, frequency.term_frequency(tokens(given)).collect()))
    monkeypatch.setattr(frequency, "HEAVY", 2)
    assert sorted(map(tuple, frequency.term_frequency(tokens(given)).collect())) == all_heavy


def test_no_tokens_no_terms(tokens):
    assert frequency.term_frequency(tokens([])).count() == 0
    assert cooccurrence.pair_counts(tokens([])).count() == 0


def _pairs(given, field):
    held = defaultdict(set)
    for r in set(given):
        w = _term(r[3 if field == "form" else 4])
        if w and r[0] is not None:
            held[r[0]].add(w)
    n, both = Counter(), Counter()
    for terms in held.values():
        n.update(terms)
        both.update(itertools.combinations(sorted(terms), 2))
    return n, both, len({r[0] for r in given} - {None})


def test_pairs_are_those_of_brute_force(tokens, clashing):
    given = _random_tokens(3)
    for field in ("form", "lemma"):
        n, both, sections = _pairs(given, field)
        found = {(r.term_a, r.term_b): r for r in cooccurrence.pair_counts(clashing(tokens(given)), field).collect()}
        assert {k: r.n_ab for k, r in found.items()} == dict(both)
        for (a, b), r in found.items():
            assert (r.n_a, r.n_b, r.n_sections) == (n[a], n[b], sections)
            assert abs(r.ratio - both[a, b] * sections / (n[a] * n[b])) < 1e-9
            cells = [both[a, b], n[a] - both[a, b], n[b] - both[a, b], sections - n[a] - n[b] + both[a, b]]
            w, x, y, z = (c + 0.5 for c in cells)
            assert abs(r.odds_ratio - w * z / (x * y)) < 1e-9


def test_blocks_of_one_term_and_small_runs_change_nothing(tokens, monkeypatch):
    given = _random_tokens(4)
    want = sorted(map(tuple, cooccurrence.pair_counts(tokens(given)).collect()))
    monkeypatch.setattr(cooccurrence, "BLOCK", 3)
    monkeypatch.setattr(cooccurrence, "RUN", 7)
    assert sorted(map(tuple, cooccurrence.pair_counts(tokens(given)).collect())) == want


def test_bounds_lose_no_pair(tokens):
    given = _random_tokens(5, 120)
    n, both, sections = _pairs(given, "lemma")
    want = {k for k, v in both.items() if v >= 8 and v * sections >= 1 * n[k[0]] * n[k[1]]}
    found = cooccurrence.pair_counts(tokens(given), "lemma", least=8, lift=1).collect()
    assert {(r.term_a, r.term_b) for r in found} == want
