"""Keyword groups: placeholders in collocations, distributions, frequencies by year. The keyword table is small; its size decides how it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .collocations import collocations
from .frequency import by_subsets, held_subsets


def groups(keywords: DataFrame) -> DataFrame:
    """(keyword_category, group_n, first_lemma, placeholder): the placeholder is __ and the first three lemmas, with -... if there are more."""
    by = keywords.where("lemma is not null").groupBy("keyword_category", "group_n").agg(F.transform(F.sort_array(F.collect_list(F.struct("lemma_n", "lemma"))), lambda x: x["lemma"]).alias("lemmas"))
    more = F.when(F.size("lemmas") > 3, "-...").otherwise("")
    return by.select("keyword_category", "group_n", F.col("lemmas")[0].alias("first_lemma"), F.concat(F.lit("__"), F.array_join(F.slice("lemmas", 1, 3), "-"), more).alias("placeholder"))


def with_placeholders(tokens: DataFrame, keywords: DataFrame, category: str) -> DataFrame:
    """Tokens whose lemma is in a group of the category get the group's placeholder as form and lemma; the first group wins."""
    own = keywords.where(F.col("keyword_category") == category)
    first = own.where("lemma is not null").groupBy("lemma").agg(F.min("group_n").alias("group_n"))
    mark = first.join(groups(own), "group_n").select("lemma", "placeholder")
    joined = tokens.join(mark, "lemma", "left")
    return joined.withColumns({"form": F.coalesce("placeholder", "form"), "lemma": F.coalesce("placeholder", "lemma")}).drop("placeholder")


def keyword_collocations(tokens: DataFrame, keywords: DataFrame, category: str, fields: list[str], size: int = 2, boundary: str = "corpus", by_subset: bool = False) -> DataFrame:
    """N-grams that hold a keyword group. A category without keywords filters nothing."""
    marked = with_placeholders(tokens, keywords, category)
    some = keywords.where((F.col("keyword_category") == category) & F.col("lemma").isNotNull()).limit(1).count() > 0
    return collocations(marked, fields, size, boundary, placeholders=some, by_subset=by_subset)


def marks(keywords: DataFrame) -> DataFrame:
    """(lemma, placeholders): of each category that lists the lemma the placeholder of its first group that does."""
    first = keywords.where("lemma <> ''").groupBy("keyword_category", "lemma").agg(F.min("group_n").alias("group_n"))
    named = first.join(groups(keywords), ["keyword_category", "group_n"])
    return named.groupBy("lemma").agg(F.map_from_entries(F.collect_list(F.struct("keyword_category", "placeholder"))).alias("placeholders"))


def every_keyword_collocations(tokens: DataFrame, keywords: DataFrame, fields: list[str], size: int = 2, boundary: str = "corpus", by_subset: bool = False) -> DataFrame:
    """([subset, ]keyword_category, w1_*, ...): N-grams that hold a keyword group, of all categories."""
    return collocations(tokens, fields, size, boundary, marks=marks(keywords), by_subset=by_subset)


def keyword_distribution(lemma_counts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(subset, keyword_category, group_n, first_lemma, lemma_n, lemma, n, group_sum), groups by their sum, lemmas by n.

    lemma_counts has subset, lemma, n. Every lemma of every group comes out for every subset, also with 0: a
    report that hides lemmas of 0 still shows their group.
    """
    subsets = lemma_counts.select("subset").distinct()
    names = groups(keywords).select("keyword_category", "group_n", "first_lemma")
    listed = keywords.where("lemma is not null").select("keyword_category", "group_n", "lemma_n", "lemma")
    grid = subsets.crossJoin(listed)  # every subset shows every group, so that is the size of the result
    counts = grid.join(lemma_counts.select("subset", "lemma", "n"), ["subset", "lemma"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("subset", "keyword_category", "group_n"))
    return (
        counts.withColumn("group_sum", total).join(names, ["keyword_category", "group_n"])
        .select("subset", "keyword_category", "group_n", "first_lemma", "lemma_n", "lemma", "n", "group_sum")
        .orderBy("subset", "keyword_category", F.desc("group_sum"), "group_n", F.desc("n"), "lemma_n")
    )


def keyword_report(distribution: DataFrame) -> DataFrame:
    """(subset, keyword_category, group_n, line): the lines of a printed report, the group's line first, lemmas of 0 hidden."""
    head = distribution.select("subset", "keyword_category", "group_sum", "group_n", F.lit(None).cast("long").alias("n"), F.lit(-1).alias("lemma_n"), F.concat(F.lit("##"), "first_lemma", F.lit(" etc. - "), F.col("group_sum").cast("string")).alias("line")).distinct()
    lemmas = distribution.where("n > 0").select("subset", "keyword_category", "group_sum", "group_n", "n", F.col("lemma_n"), F.concat("lemma", F.lit(" - "), F.col("n").cast("string")).alias("line"))
    order = ["subset", "keyword_category", F.desc("group_sum"), "group_n", F.expr("n is not null"), F.desc("n"), "lemma_n"]
    return head.unionByName(lemmas).orderBy(*order).select("subset", "keyword_category", "group_n", "line")


def group_years(words: DataFrame, keywords: DataFrame, first_year: int = 1572, last_year: int = 1696) -> DataFrame:
    """([subset, ]keyword_group, year, n): how often a group's lemmas occur in dated sections; a lemma that a group lists twice counts twice.

    Of every subset, if words has an array subsets.
    """
    names = groups(keywords).select("keyword_category", "group_n", F.concat_ws("_", "keyword_category", "first_lemma").alias("keyword_group"))
    listed = keywords.where("lemma is not null").join(names, ["keyword_category", "group_n"]).select("lemma", "keyword_group")
    year, keys = F.year("date"), held_subsets(words)
    by_lemma = words.where(year.between(first_year, last_year)).groupBy(*keys, "lemma", year.alias("year")).agg(F.count("*").alias("n"))
    counted = by_lemma.join(listed, "lemma").groupBy(*keys, "keyword_group", "year").agg(F.sum("n").alias("n"))
    return by_subsets(counted, ["keyword_group", "year"])
