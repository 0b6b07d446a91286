from __future__ import annotations

import os

from laudarium.numbering import dense_ids
from laudarium.session import drop_written, written


def test_tables_are_written_and_dropped(spark):
    df = written(spark.range(10), "t")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 10 and os.path.exists(path)
    drop_written(spark)
    assert not os.path.exists(path)


def test_numbers_are_dense_and_in_order(spark):
    words = [f"w{k:04d}" for k in range(500)]
    got = dense_ids(spark.createDataFrame([(w,) for w in reversed(words)], "w string").repartition(7), "w", "id").collect()
    assert sorted((r.w, r.id) for r in got) == list(zip(words, range(500)))
    assert dense_ids(spark.createDataFrame([], "w string"), "w", "id").count() == 0
