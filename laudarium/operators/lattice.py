"""Lattices of morphological variants: positions, probabilities, sentences, paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import stringified


def merge_variants(arcs: DataFrame) -> DataFrame:
    """(sent, start, end, variants): arcs (sent, start, end, orth, base, tag, arc_n) by position, variants in order; positions by start, then end."""
    variant = F.struct("arc_n", *[stringified(F.col(c)).alias(c) for c in ("orth", "base", "tag")])
    by = arcs.groupBy("sent", "start", "end").agg(F.sort_array(F.collect_list(variant)).alias("variants"))
    return by.select("sent", "start", "end", F.transform("variants", lambda v: F.struct(v["orth"].alias("orth"), v["base"].alias("base"), v["tag"].alias("tag"))).alias("variants")).orderBy("sent", "start", "end")


def weighted_arcs(arcs: DataFrame) -> DataFrame:
    """Each variant with the probability 1/n of its position, and eos on those of the last position of the sentence."""
    position = Window.partitionBy("sent", "start", "end")
    last = F.max(F.struct("start", "end")).over(Window.partitionBy("sent"))
    return arcs.withColumn("prob", 1 / F.count("*").over(position)).withColumn("eos", F.when(F.struct("start", "end") == last, "eos").otherwise(""))


def split_sentences(positions: DataFrame) -> DataFrame:
    """positions (par, pos_n, is_stop, is_brev) with sent_n from 0: a stop ends a sentence unless it or what precedes it is an abbreviation."""
    by = Window.partitionBy("par").orderBy("pos_n")
    brev = F.coalesce("is_brev", F.lit(False))
    ends = F.coalesce("is_stop", F.lit(False)) & ~brev & ~F.coalesce(F.lag(brev).over(by), F.lit(False))
    return positions.withColumn("_end", ends.cast("int")).withColumn("sent_n", F.coalesce(F.sum("_end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).drop("_end")


def spaces_before(tokens: DataFrame) -> DataFrame:
    """tokens (par, pos_n, start, end) with after_space: whether something lies between the token and the one before."""
    by = Window.partitionBy("par").orderBy("pos_n")
    return tokens.withColumn("after_space", ~F.coalesce(F.lag("end").over(by) == F.col("start"), F.lit(False)))


def tagger_rows(lines: DataFrame) -> DataFrame:
    """Chosen rows of a tagger's output (sent, line_n, line of 12 columns): one, the first, for each start and end."""
    cells = F.split("line", "\t")
    at = lambda k: F.get(cells, F.lit(k))
    chosen = lines.where((F.size(cells) == 12) & F.col("line").rlike("disamb\r?$")).select("sent", "line_n", at(0).try_cast("int").alias("start"), at(1).try_cast("int").alias("end"), at(2).alias("form"), at(3).alias("lemma"), F.split(at(4), ":").alias("interp"))
    first = F.row_number().over(Window.partitionBy("sent", "start", "end").orderBy("line_n"))
    return chosen.withColumn("_k", first).where("_k = 1").drop("_k", "line_n")


def _paths(edges: dict[int, list[int]], starts: list[int]) -> Iterator[list[int]]:
    todo = [[s] for s in reversed(starts)]
    while todo:
        path = todo.pop()
        after = [x for x in edges.get(path[-1], []) if x not in path]
        if after:
            todo += [[*path, x] for x in reversed(after)]
        else:
            yield path


def all_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(sent, path_n, path): every way from a start through edges (sent, from_token, to_token) to an end, in order of tokens.

    One sentence is one group; its paths are made one by one and leave as they are made.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        firsts = sorted(rows.loc[rows["to_token"].isna(), "from_token"].unique())
        after: dict[int, list[int]] = {}
        for a, b in sorted(set(rows.dropna(subset=["to_token"])[["from_token", "to_token"]].astype(int).itertuples(index=False, name=None))):
            after.setdefault(a, []).append(b)
        for n, path in enumerate(_paths(after, [int(x) for x in firsts])):
            yield pd.DataFrame({"sent": [key[0]], "path_n": [n], "path": [path]})

    both = edges.select("sent", "from_token", "to_token").where("to_token is not null").unionByName(starts.select("sent", F.col("token").alias("from_token"), F.lit(None).cast("int").alias("to_token")))
    return both.groupBy("sent").applyInPandas(run, "sent long, path_n int, path array<int>")


def positions(paths: list[list[int]]):
    """The position view of a sentence's paths: tokens on all paths stand alone, what differs between them is a list of alternatives."""
    common = [t for t in paths[0] if all(t in p for p in paths)]
    out, at = [], [0] * len(paths)
    for stop in [*common, None]:
        parts = []
        for k, p in enumerate(paths):
            to = p.index(stop) if stop is not None else len(p)
            part = p[at[k] : to]
            at[k] = to + 1
            if part not in parts:
                parts.append(part)
        if any(parts):
            out.append([x[0] if len(x) == 1 else x for x in parts])
        if stop is not None:
            out.append(stop)
    return out


def path_positions(paths: DataFrame) -> DataFrame:
    """(sent, position_n, alternatives) of all_paths(): the position view of each sentence, a list of ways through each position.

    A token that all paths have is the only way of its position.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        said = [[int(t) for t in p] for p in rows.sort_values("path_n")["path"]]
        ways = [[x] if isinstance(x, int) else [y if isinstance(y, list) else [y] for y in x] for x in positions(said)]
        ways = [[[w[0]]] if w and isinstance(w[0], int) else w for w in ways]
        return pd.DataFrame({"sent": key[0], "position_n": range(len(ways)), "alternatives": ways})

    return paths.select("sent", "path_n", "path").groupBy("sent").applyInPandas(run, "sent long, position_n int, alternatives array<array<int>>")
