"""A mix of sources in given shares: hash-random order, running sums of sizes, a cut at the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tokenizer import VOCABULARY, n_tokens

#: Ranges of the random key in a source, a power of two; the running sum goes over ranges, then within one.
RANGES = 4096


def _name(c: str):
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def placed(documents: DataFrame, seed: int, vocabulary: str) -> DataFrame:
    """(doc_id, name, size, key, upto): records in the order of a random key, a hash, with the running sum of sizes of their source up to them.

    Sizes are summed by range of the key, these sums run on over at most RANGES rows of a source, and records
    run on within their range, so no source is one task's work. Written, so that a row keeps its size.
    """
    sized = written(
        documents.select("doc_id", _name("source").alias("name"), n_tokens(vocabulary)("text").alias("size"))
        .withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("part", F.shiftright("key", 64 - (RANGES.bit_length() - 1))),
        "sized",
    )
    earlier = F.sum("sum").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    within = F.sum("size").over(Window.partitionBy("name", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = sized.where("name is not null").groupBy("name", "part").agg(F.sum("size").alias("sum")).withColumn("before", F.coalesce(earlier, F.lit(0))).drop("sum")
    named = sized.join(before, ["name", "part"]).select("doc_id", "name", "size", "key", (F.col("before") + within).alias("upto"))
    nameless = sized.where("name is null").select("doc_id", "name", "size", "key", F.lit(None).cast("long").alias("upto"))
    return written(named.unionByName(nameless), "placed")


def cuts(rows: DataFrame, targets: DataFrame, size: int | str | None = None) -> DataFrame:
    """By source of targets, where its budget cuts the running sum, round after round of its records.

    A round ends where the running sum of the last record does (epoch). budget is target_share of the size of
    the mix: of all tokens if size is None; size if it is a number; if it is "feasible", of the largest size at
    which every source that holds anything reaches its share. rounds are used in full, and within the next one
    the cut is at `left`. reachable tells whether max_repeats rounds get as far as the budget.
    """
    ends = rows.where("name is not null").groupBy("name").agg(F.max("upto").alias("epoch"))
    every = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all_tokens"))
    plan = (
        targets.where("source is not null").select("source", "target_share", "max_repeats", _name("source").alias("name"))
        .join(ends, "name", "left").na.fill(0, ["epoch"])
        .withColumns({"target": F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), "reach": F.col("epoch") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))})
    )
    most = plan.agg(F.min(F.when((F.col("reach") > 0) & (F.col("target") > 0), F.col("reach") / F.col("target"))).alias("most"))
    sizes = every.crossJoin(most).select("all_tokens", F.coalesce(F.floor("most"), F.lit(0)).alias("feasible_size"))  # one row each
    asked = F.col("all_tokens") if size is None else F.col("feasible_size") if size == "feasible" else F.lit(int(size))
    out = (
        plan.crossJoin(sizes).withColumn("mix_size", asked.cast("long"))
        .withColumn("budget", F.floor(F.col("target") * F.col("mix_size") + 1e-6))
        .withColumn("reachable", F.col("reach") >= F.col("budget"))
        .withColumn("spent", F.least("reach", "budget"))
        .withColumn("rounds", F.when(F.col("epoch") > 0, F.expr("spent div epoch")).otherwise(0))
        .withColumn("left", F.col("spent") - F.col("rounds") * F.col("epoch"))
    )
    return written(out, "cuts")  # a row for each source of the targets: its size in the file decides whether it is broadcast


def _once_more(rows: DataFrame, plan: DataFrame, passes: int = 3) -> DataFrame:
    """(doc_id, name, size, key, upto) of the records that are used once more than in full rounds: those up to the cut.

    The cut stops before the record that would exceed the budget. A later pass goes on with the unused
    records that are no larger than what is then left, so that one very long text does not leave a gap.
    """
    part = F.shiftright("key", 64 - (RANGES.bit_length() - 1))
    earlier = F.sum("sum").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    within = F.sum("size").over(Window.partitionBy("name", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    used = rows.join(plan.select("name", "left"), "name").where((F.col("size") > 0) & (F.col("upto") <= F.col("left")))
    used = written(used.select("doc_id", "name", "size", "key", "upto"), "used")
    for _ in range(passes - 1):
        spent = used.groupBy("name").agg(F.sum("size").alias("so_far"))
        left = written(plan.join(spent, "name", "left").select("name", (F.col("left") - F.coalesce("so_far", F.lit(0))).alias("left")), "left")
        able = rows.join(left, "name").where((F.col("size") > 0) & (F.col("size") <= F.col("left"))).withColumn("part", part)
        able = able.join(used.select("doc_id", "upto"), ["doc_id", "upto"], "left_anti")
        starts = able.groupBy("name", "part").agg(F.sum("size").alias("sum")).withColumn("before", F.coalesce(earlier, F.lit(0))).drop("sum")
        more = able.join(starts, ["name", "part"]).withColumn("run", F.col("before") + within).where("run <= left").select("doc_id", "name", "size", "key", "upto")
        used = used.unionByName(written(more, "used"))
    return used


def mix(documents: DataFrame, targets: DataFrame, seed: int = 1, vocabulary: str = VOCABULARY, size: int | str | None = "feasible") -> tuple[DataFrame, DataFrame]:
    """(records, shares).

    records (doc_id, source, n_tokens, uses): every record of the mix with how often it is used: all rounds that
    fit the source's budget in full, and one more for those at the head of the random order whose running sum
    stays within what is left. shares (source, target_share, max_repeats, budget, n_tokens, share_of_size,
    actual_share, reachable, mix_size, feasible_size): what each source gives, its share of the size asked for
    and of the mix as it is.

    size is the number of tokens of the mix: "feasible" (the largest at which every source that has records
    reaches its share), None (as large as all documents together; what a source cannot reach is missing), or a
    number. The order within a source is that of a hash of doc_id. Names compare without case and outer blanks. Records without source, or of
    a source that has no target, count in the size of all documents and are not used. A null text has no
    tokens. Equal hashes are ordered by doc_id; rows with one doc_id are records of
    their own. max_repeats null counts as 0, target_share null as 0.
    """
    rows = placed(documents, seed, vocabulary)
    plan = cuts(rows, targets, size)
    more = _once_more(rows, plan).select("doc_id", "upto", F.lit(1).alias("more"))
    records = written(
        rows.join(plan.select("name", "source", "rounds", "max_repeats"), "name").join(more, ["doc_id", "upto"], "left")
        .withColumn("uses", F.least(F.col("rounds") + F.coalesce("more", F.lit(0)), F.col("max_repeats").cast("long")))
        .where("uses > 0").select("doc_id", "source", F.col("size").alias("n_tokens"), "uses"),
        "records",
    )
    taken = records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"))
    everything = F.sum("n_tokens").over(Window.partitionBy())  # over the sources of the targets
    of = lambda whole: F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0)
    shares = (
        plan.join(taken, "source", "left").na.fill(0, ["n_tokens"])
        .select("source", "target_share", "max_repeats", "budget", "n_tokens", of(F.col("mix_size")).alias("share_of_size"), of(everything).alias("actual_share"), "reachable", "mix_size", "feasible_size")
    )
    return records, shares


def found(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Sources whose records, in all the rounds they may be used, do not get as far as their budget in a mix as large as all documents."""
    return mix(documents, targets, vocabulary=vocabulary, size=None)[1].where("not reachable").select("source")
