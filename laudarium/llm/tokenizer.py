"""Sizes in tokens of a public byte-level tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import bisect
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str):
    """Loaded once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, path: str = VOCABULARY) -> list[int]:
    return encoding(path).encode_ordinary(text)


def n_tokens(path: str = VOCABULARY):
    """A function of a text column: its number of tokens; 0 for null."""

    @arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        given = ["" if t is None else t for t in texts.to_pylist()]
        return pa.array([len(x) for x in encoding(path).encode_ordinary_batch(given, num_threads=1)], pa.int64())

    return count


def cut_points(text: str, most: int, path: str = VOCABULARY) -> list[int]:
    """Character places at which text is cut into pieces of at most `most` tokens: 0, ..., len(text).

    Cuts stand where the tokenizer's own pattern begins a new word, so a piece's tokens are those of the
    whole; only a single word that is longer than a piece is cut within, at whole characters.
    """
    import regex

    ends, sizes = [], []
    for m in regex.finditer(PATTERN, text):
        size = len(token_ids(m.group(), path))
        if size <= most:
            ends.append(m.end())
            sizes.append(size)
        else:  # halve until it fits
            todo = [(m.start(), m.end())]
            while todo:
                a, b = todo.pop()
                k = len(token_ids(text[a:b], path))
                if k <= most or b - a == 1:
                    ends.append(b)
                    sizes.append(k)
                else:
                    todo += [((a + b) // 2, b), (a, (a + b) // 2)]
    total = list(accumulate(sizes, initial=0))
    places, at = [0], 0
    while at < len(sizes):
        to = max(at + 1, bisect.bisect_right(total, total[at] + most) - 1)
        start = places[-1]
        while to > at + 1 and len(token_ids(text[start : ends[to - 1]], path)) > most:  # white space at a cut may count once more
            to -= 1
        places.append(ends[to - 1])
        at = to
    return places
