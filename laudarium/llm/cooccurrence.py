"""Terms that occur in the same section: packed pair codes, sorted runs, a merge, run lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..numbering import dense_ids
from ..session import written
from .tokens import delivered_once, term_of

#: Terms of a section in one block; a row never stands for more than BLOCK * BLOCK pairs.
BLOCK = 4096
#: Codes that a task sorts at once; a run.
RUN = 1 << 22


def _runs(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths of sorted codes, or the sums of n over the runs."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.diff(np.append(starts, len(codes))) if n is None else np.add.reduceat(n, starts)


def _batch(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])


def _pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids_a, ids_b) to sorted runs of (code, n): a code is the smaller id in the upper 32 bits, the other below."""
    held, size = [], 0

    def run() -> Iterator[pa.RecordBatch]:
        codes, n = _runs(np.sort(np.concatenate(held)))
        for k in range(0, len(codes), 100_000):
            yield _batch(codes[k : k + 100_000], n[k : k + 100_000])

    for batch in batches:
        for a, b in zip(batch.column("ids_a"), batch.column("ids_b")):
            left = a.values.to_numpy(zero_copy_only=False)
            if b.is_valid:
                right = b.values.to_numpy(zero_copy_only=False)
                codes = ((left[:, None] << 32) | right[None, :]).ravel()
            else:
                i, j = np.triu_indices(len(left), 1)
                codes = (left[i] << 32) | left[j]
            held.append(codes)
            size += len(codes)
            if size >= RUN:
                yield from run()
                held, size = [], 0
    if size:
        yield from run()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (code, n) to one row for each code; the last code waits for the next batch."""
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        code, n = _runs(np.concatenate((code, batch.column("code").to_numpy())), np.concatenate((n, batch.column("n").to_numpy())))
        if len(code) > 1:
            yield _batch(code[:-1], n[:-1])
            code, n = code[-1:], n[-1:]
    if len(code):
        yield _batch(code, n)


def pair_counts(tokens: DataFrame, field: str = "lemma", least: int = 1, lift: int = 0) -> DataFrame:
    """(term_a, term_b, n_a, n_b, n_ab, n_sections, ratio, odds_ratio) of every pair of terms used in one section.

    n counts sections; ratio is n_ab * N / (n_a * n_b), odds_ratio that of the 2 x 2 table with one half
    added to each cell. With least and lift only pairs with n_ab >= least and ratio >= lift come out; terms
    that can be in no such pair (n < least, or n * lift > N, since n_ab is at most either n) are left out
    before pairs are made, which loses nothing.

    Null or blank terms and tokens without a section make no pairs; copies count once; a term makes no pair
    with itself. An empty table gives no rows.
    """
    used = written(delivered_once(tokens).where("section_id is not null").select("section_id", term_of(field).alias("term")).where("term is not null").distinct(), "terms")
    total = tokens.agg(F.count_distinct("section_id").alias("n_sections"))
    all_sections = total.first()["n_sections"]
    terms = used.groupBy("term").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") * lift <= all_sections))
    terms = written(dense_ids(terms, "term", "id").where(F.assert_true(F.col("id") < 1 << 31, "more terms than a code has room for").isNull()), "vocabulary")
    blocks = (
        used.join(terms.select("term", "id"), "term")
        .groupBy("section_id", F.expr(f"id div {BLOCK}").alias("block"))
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    a = blocks.select("section_id", F.col("block").alias("block_a"), F.col("ids").alias("ids_a"))
    b = blocks.select("section_id", F.col("block").alias("block_b"), F.col("ids").alias("ids_b"))
    within = a.select("ids_a", F.lit(None).cast("array<long>").alias("ids_b"))
    across = a.join(b, "section_id").where("block_a < block_b").repartition("section_id", "block_a", "block_b").select("ids_a", "ids_b")  # the pairs of one section are many tasks' work
    runs = within.unionByName(across).mapInArrow(_pair_runs, "code long, n long")
    counts = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merged, "code long, n long").where(F.col("n") >= least)

    def side(x: str) -> DataFrame:
        return terms.select(F.col("id").alias(f"id_{x}"), F.col("term").alias(f"term_{x}"), F.col("n").alias(f"n_{x}"))

    n, n_a, n_b, n_ab = F.lit(all_sections), F.col("n_a"), F.col("n_b"), F.col("n_ab")
    half = lambda cell: cell.cast("double") + 0.5
    return (
        counts.select(F.shiftright("code", 32).alias("id_a"), F.col("code").bitwiseAND((1 << 32) - 1).alias("id_b"), F.col("n").alias("n_ab"))
        .join(side("a"), "id_a").join(side("b"), "id_b")
        .where(n_ab * n >= n_a * n_b * lift)
        .select(
            "term_a", "term_b", "n_a", "n_b", "n_ab", n.cast("long").alias("n_sections"),
            (n_ab * n / (n_a * n_b)).alias("ratio"),
            (half(n_ab) * half(n - n_a - n_b + n_ab) / (half(n_a - n_ab) * half(n_b - n_ab))).alias("odds_ratio"),
        )
    )


def found(tokens: DataFrame) -> DataFrame:
    return pair_counts(tokens, "lemma", least=8, lift=4).select(F.col("term_a").alias("lemma_a"), F.col("term_b").alias("lemma_b"))
