"""Dense numbers and running sums without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

_ROW_BITS = 33


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with consecutive numbers from 0 in the order of the (unique) column key.

    The range-partitioned rows are written once, so the numbers cannot change when a task runs again;
    only one count for each partition goes to the driver.
    """
    spark = df.sparkSession
    placed = written(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()), "ids")
    parts = placed.groupBy(F.shiftright("_at", _ROW_BITS).alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()
    starts = [0, *accumulate(r["_n"] for r in parts)]
    offsets = spark.createDataFrame([(r["_part"], s) for r, s in zip(parts, starts)], "_part long, _start long")
    return (
        placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
        .join(F.broadcast(offsets), "_part")  # one row for each partition of the write
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_part", "_start", "_at")
    )


Values = dict[str, Column]


def carry(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], before: Values | None = None, after: Values | None = None, upto: Values | None = None, earlier: Values | None = None) -> DataFrame:
    """df with new columns by name, of the rows of equal keys (not null) in the order of `order`.

    before: the last value that is not null in the rows before a row; after: the first in those after it; upto: the sum
    of a value over the rows up to and with a row; earlier: without it.

    block must not fall in that order. Values go on over the blocks first and within a block then, so a task has a
    block, never all rows of a key. df is read twice: write it before, if it is not cheap.
    """
    before, after, upto, earlier = before or {}, after or {}, upto or {}, earlier or {}
    own, near, sums = [*keys, "_block"], before | after, upto | earlier
    marked = df.withColumn("_block", block).withColumns({f"_of_{n}": v for n, v in (near | sums).items()})
    place = lambda n: F.when(F.col(f"_of_{n}").isNotNull(), F.struct(*order))
    edges = marked.groupBy(*own).agg(
        *[F.max_by(f"_of_{n}", place(n)).alias(f"_edge_{n}") for n in before], *[F.min_by(f"_of_{n}", place(n)).alias(f"_edge_{n}") for n in after],
        *[F.sum(f"_of_{n}").alias(f"_edge_{n}") for n in sums],
    )
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    blocks, rows = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*own).orderBy(*order)

    def over(name: str, source: str, window: Window, inner: bool) -> Column:
        c = F.col(f"{source}_{name}")
        if name in sums:
            return F.sum(c).over(window.rowsBetween(first, 0 if inner and name in upto else -1))
        return F.last(c, ignorenulls=True).over(window.rowsBetween(first, -1)) if name in before else F.first(c, ignorenulls=True).over(window.rowsBetween(1, last))

    names = [*near, *sums]
    carried = edges.select(*own, *[over(n, "_edge", blocks, False).alias(f"_from_{n}") for n in names])
    inner = marked.withColumns({n: over(n, "_of", rows, True) for n in names})
    zero = F.lit(0)
    out = inner.join(carried, own).withColumns({n: F.coalesce(n, zero) + F.coalesce(f"_from_{n}", zero) if n in sums else F.coalesce(n, f"_from_{n}") for n in names})
    return out.drop("_block", *[f"_of_{n}" for n in names], *[f"_from_{n}" for n in names])
