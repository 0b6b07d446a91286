from __future__ import annotations

import random

from pyspark.sql import functions as F

from laudarium.numbering import carry, dense_ids


def test_values_and_sums_go_on_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.choice([None, None, n * 10]), rng.randint(0, 5)) for k in ("a", "b") for n in range(1, 60)]
    df = spark.createDataFrame(rows, "k string, n int, v int, w int")
    block = F.floor(F.col("n") / 7)
    v, w = F.col("v"), F.col("w")
    out = carry(df, ["k"], block, ["n"], before={"before": v}, after={"after": v}, upto={"upto": w}, earlier={"earlier": w})
    for r in out.collect():
        own = [(n, v, w) for k, n, v, w in rows if k == r.k]
        assert r.before == next((v for n, v, _ in reversed(own) if n < r.n and v is not None), None)
        assert r.after == next((v for n, v, _ in own if n > r.n and v is not None), None)
        assert r.upto == sum(w for n, _, w in own if n <= r.n) and r.earlier == r.upto - r.w


def test_numbers_are_dense(spark):
    got = dense_ids(spark.range(0, 1000, 7).withColumnRenamed("id", "key"), "key", "n").orderBy("key").collect()
    assert [r.n for r in got] == list(range(len(got)))
