"""How well sections were told apart: lengths of documents against the true ones, all editions at once.

A document is compared by its share of an edition's text, as pages. Where counts differ, neighbours are put
together (or a document is shared out between two true ones) on the way through the edition, from the front
and from the back, and the nearer of both ways counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..numbering import carry
from ..session import written
from .loader import SECTIONS


def true_lengths(pages: Sequence[int]) -> list[int]:
    """Pages of each document from the first pages: the gap to the next, and one more, for pages are shared."""
    return [b - a + 1 for a, b in zip(pages, pages[1:])]


def page_lengths(starts: DataFrame) -> DataFrame:
    """(edition, document_n, pages) from (edition, document_n, start_page); the last document of an edition has no next one and is left out."""
    ahead = carry(written(starts.select("edition", "document_n", "start_page"), "starts"), ["edition"], F.floor(F.col("document_n") / SECTIONS), ["document_n"], after={"following": F.col("start_page")})
    return ahead.select("edition", "document_n", (F.col("following") - F.col("start_page") + 1).alias("pages")).where("pages is not null")


def _numbered(lengths: Column) -> Column:
    return F.transform(lengths, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.get(lengths, i + 1).alias("following")))


def _put_together(found: Column, true: Column) -> Column:
    """The squared distance where at least as many documents are found as there are: each joins the open group or begins the next.

    It joins if more than half of it lies before the true end of the group and enough documents are left for
    the true ones to come; the last group takes all.
    """
    n, m = F.size(found), F.size(true)

    def step(at: Column, d: Column) -> Column:
        to_come = m - at["k"]
        spare = n - d["i"] > to_come
        joins = (d["i"] == 0) | (to_come == 0) | (spare & (d["x"] > 0) & (at["open"] + d["x"] / 2 < F.get(true, at["k"] - 1)))
        closed = F.pow(F.get(true, at["k"] - 1) - at["open"], F.lit(2.0))
        return F.when(joins, F.struct(at["k"].alias("k"), (at["open"] + d["x"]).alias("open"), at["far"].alias("far"))).otherwise(
            F.struct((at["k"] + 1).alias("k"), d["x"].alias("open"), (at["far"] + closed).alias("far"))
        )

    start = F.struct(F.lit(1).alias("k"), F.lit(0.0).alias("open"), F.lit(0.0).alias("far"))
    return F.aggregate(_numbered(found), start, step, lambda at: at["far"] + F.pow(F.get(true, at["k"] - 1) - at["open"], F.lit(2.0)))


def _shared_out(found: Column, true: Column) -> Column:
    """The squared distance where fewer documents are found than there are, but at least half as many: each is one true document, or two in their proportion.

    It is two if that is nearer than it as the first and the next one as the second, or if there are no more
    than two true ones for each that is left; never if that would leave later ones without any.
    """
    n, m = F.size(found), F.size(true)
    square = lambda x: x * x

    def step(at: Column, d: Column) -> Column:
        left, to_come = n - d["i"], m - at["k"]
        one, two = F.get(true, at["k"]), F.get(true, at["k"] + 1)
        apart = square(d["x"] / (one + two) - 1) * (square(one) + square(two))
        as_one = square(d["x"] - one)
        both = (to_come > left) & ((to_come >= 2 * left) | F.coalesce(apart < as_one + square(d["following"] - two), F.lit(False)))
        return F.struct((at["k"] + F.when(both, 2).otherwise(1)).alias("k"), (at["far"] + F.when(both, apart).otherwise(as_one)).alias("far"))

    return F.aggregate(_numbered(found), F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("far")), step, lambda at: at["far"])


def indexing_scores(documents: DataFrame, truth: DataFrame) -> DataFrame:
    """(edition, distance, difference, score) of documents (edition, document_n, text_length) and truth (edition, document_n, pages).

    distance is the root of the squared differences of lengths in pages, difference that of the counts, score
    their sum. Fewer than half as many documents as there are, or texts of no length at all, give null. An
    edition comes out if it is in both tables. Of an edition only its lengths are gathered, a number a document.
    """
    ordered = lambda value: F.transform(F.sort_array(F.collect_list(F.struct("document_n", F.col(value).cast("double").alias("x")))), lambda d: d["x"])
    found = documents.where("text_length is not null").groupBy("edition").agg(ordered("text_length").alias("lengths"), F.sum("text_length").alias("size"))
    true = truth.where("pages is not null").groupBy("edition").agg(ordered("pages").alias("true"), F.sum("pages").alias("pages"))
    both = found.join(true, "edition").withColumn("scaled", F.when(F.col("size") > 0, F.transform("lengths", lambda x: x / F.col("size") * F.col("pages"))))
    ways = [(F.col("scaled"), F.col("true")), (F.reverse("scaled"), F.reverse("true"))]
    n, m = F.size("lengths"), F.size("true")
    far = lambda fold: F.least(*[fold(*way) for way in ways])
    distance = F.sqrt(F.when(n >= m, far(_put_together)).when(2 * n >= m, far(_shared_out)))
    return both.select("edition", distance.alias("distance"), F.abs(n - m).alias("difference"), (distance + F.abs(n - m)).alias("score"))
