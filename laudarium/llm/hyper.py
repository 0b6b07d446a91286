"""Hyperdimensional language profiles: permuted random letter vectors bound into n-grams, bundled, compared by cosine."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from zlib import crc32

import numpy as np

DIMENSIONS = 2048
GRAMS = (1, 2, 3)
WHOLE = 3
LONGEST = 40
SEED = 20_000_003
#: n-grams whose scores a worker keeps before it starts again.
KEPT = 400_000
#: Texts of a language that profiles are made of, at most; they are 8 KB each on the driver.
TEXTS = 1300

_WORD = re.compile(r"[㐀-鿿]|[^\W\d_]+")


def words(text: str) -> list[str]:
    """Words in lower case; of Chinese, which has no blanks, every character is one."""
    return _WORD.findall(text.lower())


def grams(word: str) -> list[str]:
    """The n-grams of a word with the blanks around it, and the word itself, WHOLE times: names, in any language, share n-grams.

    A run of more than LONGEST letters is no word and counts by its n-grams alone.
    """
    said = f" {word} "
    return [said[i : i + n] for n in GRAMS for i in range(len(said) - n + 1) if said[i : i + n] != " "] + [said] * (WHOLE if len(word) <= LONGEST else 0)


_letter_vectors: dict[str, np.ndarray] = {}


def _letter(ch: str) -> np.ndarray:
    """The random vector of a letter, of +1 and -1, the same in every process."""
    if (v := _letter_vectors.get(ch)) is None:
        v = _letter_vectors[ch] = (np.random.default_rng(SEED + ord(ch)).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)
    return v


@lru_cache(1 << 12)
def _rolled(ch: str, places: int) -> np.ndarray:
    return np.roll(_letter(ch), places)


def gram_vector(gram: str) -> np.ndarray:
    """The letters of an n-gram, each permuted (rolled) by its place from the end, multiplied."""
    out = np.ones(DIMENSIONS, np.int8)
    for k, ch in enumerate(gram):
        out = out * _rolled(ch, len(gram) - 1 - k)
    return out


def word_vector(word: str) -> np.ndarray:
    """The n-grams of a word, bundled."""
    out = np.zeros(DIMENSIONS, np.int16)
    for g in grams(word):
        out += gram_vector(g)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


class Profiles:
    """Language prototypes of length 1, to which texts are compared by cosine.

    shared has, by language, the product of two of its words on average: words share n-grams, so a text is
    longer than its words alone would make it.
    """

    def __init__(self, languages: Sequence[str], prototypes: np.ndarray, shared: Sequence[float] = ()) -> None:
        self.languages = tuple(languages)
        self.own = _unit(prototypes)
        self.shared = tuple(map(float, shared)) or (0.0,) * len(self.languages)
        self._empty()

    def _empty(self) -> None:
        self._at: dict[str, int] = {}
        self._rows = np.zeros((1024, len(self.languages) + 1))
        self._gram_at: dict[str, int] = {}
        self._gram_rows = np.zeros((1024, len(self.languages)))
        self.kept: dict[str, float] = {}  # scores that a caller keeps

    def __reduce__(self):
        return _restored, (self.languages, self.own.astype(np.float32).tobytes(), self.shared)

    def _gram(self, gram: str) -> int:
        at = self._gram_at[gram] = len(self._gram_at)
        if at >= len(self._gram_rows):
            self._gram_rows = np.vstack([self._gram_rows, np.zeros_like(self._gram_rows)])
        self._gram_rows[at] = self.own @ gram_vector(gram)
        return at

    def _add(self, word: str) -> int:
        """A word's bundled n-grams times the prototypes, and the square of its length."""
        parts, known = grams(word), self._gram_at
        places = [known[g] if g in known else self._gram(g) for g in parts]
        at = self._at[word] = len(self._at)
        if at >= len(self._rows):
            self._rows = np.vstack([self._rows, np.zeros_like(self._rows)])
        self._rows[at, :-1] = self._gram_rows[places].sum(axis=0)
        self._rows[at, -1] = DIMENSIONS * (len(parts) + (WHOLE * WHOLE - WHOLE if len(word) <= LONGEST else 0))  # vectors of different n-grams are all but orthogonal
        return at

    def rows(self, said: Sequence[str]) -> np.ndarray:
        """For each word its products with the prototypes and, last, the square of its length; they add up over the words of a text."""
        if len(self._at) + len(said) > KEPT:
            self._empty()
        at = self._at
        places = [at[w] if w in at else self._add(w) for w in said]
        return self._rows[places] if places else np.zeros((0, len(self.languages) + 1))


    def cosines(self, total: np.ndarray, n: int) -> np.ndarray:
        """Cosines of a text of n words with the prototypes from the sum of its words' rows; the length of the text is that of its words and what they share."""
        of = total[:-1]
        return of / max(total[-1] + n * (n - 1) * self.shared[int(of.argmax())], 1.0) ** 0.5


@lru_cache(4)
def _restored(languages: tuple[str, ...], own: bytes, shared: tuple[float, ...]) -> Profiles:
    """One object in each Python worker, so that what it has learnt of words serves the next task as well."""
    out = Profiles.__new__(Profiles)
    out.languages, out.shared, out.own = languages, shared, np.frombuffer(own, np.float32).astype(np.float64).reshape(len(languages), DIMENSIONS)
    out._empty()
    return out


def confidence(of: np.ndarray) -> float:
    """Between 0 and 1: how far the best cosine stands above the next, through a logistic curve."""
    two = sorted(of.tolist())[-2:]
    if len(two) < 2:
        return 1.0
    return math.tanh(6 * (two[1] - two[0]))


def fitted(labelled: Iterable[tuple[str, str]], languages: Sequence[str], rounds: int = 3, ridge: float = 1e-3, most: int = TEXTS, whiten: bool = True) -> Profiles:
    """Profiles of a sample of texts whose labels may be wrong: of each language the first `most` in the order of a hash.

    Prototypes are the bundles of the texts of a language, whitened by the covariance of the sample (which
    takes out what the languages have in common). Then every text takes the label of its nearest prototype, by
    cosine, and they are made anew, until the labels stay or for some rounds: wrong labels, being the fewer, go.
    """
    by: dict[str, list[str]] = {k: [] for k in languages}
    for lang, text in labelled:
        if lang in by:
            by[lang].append(text)
    texts = [(k, said) for k, lang in enumerate(languages) for text in sorted(by[lang], key=lambda x: (crc32(x.encode()), x))[:most] if (said := words(text))]
    if not texts:
        return Profiles(languages, np.zeros((len(languages), DIMENSIONS)))
    vectors: dict[str, np.ndarray] = {}
    x, alone = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(languages))
    for i, (k, said) in enumerate(texts):
        for w in said:
            if (v := vectors.get(w)) is None:
                v = vectors[w] = word_vector(w)
            x[i] += v
            alone[k] += np.dot(v.astype(np.float32), v)
    vectors.clear()
    given = np.array([k for k, _ in texts])
    n_words = np.bincount(given, [len(said) for _, said in texts], len(languages))
    together = np.array([(x[given == k].sum(axis=0, dtype=np.float64) ** 2).sum() for k in range(len(languages))])
    shared = (together - alone) / np.maximum(n_words * (n_words - 1), 1)  # of two different words
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    labels = given
    for _ in range(rounds):
        y = np.eye(len(languages), dtype=np.float32)[labels]
        weight = y @ (1 / np.maximum(y.sum(axis=0), 1)) / len(languages)  # every language as much as any other
        bundles = ((x * weight[:, None]).T @ y).astype(np.float64)
        if whiten:
            covariance = np.zeros((DIMENSIONS, DIMENSIONS))
            for a in range(0, len(x), 1024):
                covariance += (x[a : a + 1024] * weight[a : a + 1024, None]).T @ x[a : a + 1024]
            covariance[np.diag_indices(DIMENSIONS)] += ridge
            bundles = np.linalg.solve(covariance, bundles)
        prototypes = _unit(bundles.T)
        now = np.argmax(x @ prototypes.T.astype(np.float32), axis=1)
        if (now == labels).all():
            break
        labels = now
    return Profiles(languages, prototypes, shared)
