"""Counts of tokens, forms and lemmas by subset; years; dictionaries; sums of the head of a list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import interp_str
from .subsets import by_attribute


def _in_subsets(by_book: DataFrame, books: DataFrame | None) -> DataFrame:
    """What is counted by book once for every subset that the book is in."""
    if books is None:
        return by_book
    known = books.select("book_title", "palatinate", "convent_location").dropDuplicates(["book_title"])
    return by_attribute(by_book.join(known, "book_title", "left")).drop("book_title", "palatinate", "convent_location")


def basic_stats(tokens: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """(subset, stat, n): sections, tokens and tokens by flag, titles included; flags that never occur have no row.

    tokens has a column subset, or book_title where books (book_title, palatinate, convent_location) are given;
    null flags are not set.
    """
    flags, key = ["corrected", "unknown_form", "proper_name", "latin"], "subset" if books is None else "book_title"
    by_section = tokens.groupBy(key, "section_id").agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in flags])
    by_book = by_section.groupBy(key).agg(F.count("*").alias("all_docs"), F.sum("n").alias("all_tokens"), *[F.sum(f).alias(f"{f}_tokens") for f in flags])
    names = ["all_docs", "all_tokens", *[f"{f}_tokens" for f in flags]]
    by = _in_subsets(by_book, books).groupBy("subset").agg(*[F.sum(n).alias(n) for n in names])
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return by.select("subset", F.expr(f"stack({len(names)}, {pairs}) as (stat, n)")).where("n > 0 or stat like 'all%'")


def counts(tokens: DataFrame, keys: Sequence[str], books: DataFrame | None = None) -> DataFrame:
    """(subset, keys, n, at): occurrences and the place of the first.

    With books, tokens are counted by book first and the counts then rolled up to subsets, so tokens are shuffled
    once and not for every subset.
    """
    own = tokens.groupBy("subset" if books is None else "book_title", *keys).agg(F.count("*").alias("n"), F.min(F.struct("section_id", "par_n", "tok_n")).alias("at"))
    if books is None:
        return own
    return _in_subsets(own, books).groupBy("subset", *keys).agg(F.sum("n").alias("n"), F.min("at").alias("at"))


def frequency(tokens: DataFrame, keys: Sequence[str], books: DataFrame | None = None) -> DataFrame:
    """(subset, keys, n, ratio, first_section, first_par, first_tok), most frequent first, ties in order of first occurrence.

    Hot words and subsets are counted before any shuffle; the order of the result is a range sort.
    """
    own = counts(tokens, keys, books)
    totals = own.groupBy("subset").agg(F.sum("n").alias("total"))
    return (
        own.join(totals, "subset")
        .select("subset", *keys, "n", F.round(F.col("n") / F.col("total"), 9).alias("ratio"), F.col("at.section_id").alias("first_section"), F.col("at.par_n").alias("first_par"), F.col("at.tok_n").alias("first_tok"))
        .orderBy("subset", F.desc("n"), "first_section", "first_par", "first_tok")
    )


def form_frequency(tokens: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """By form, lemma and tags."""
    return frequency(tokens.withColumn("tags", interp_str(F.col("interp"))), ["form", "lemma", "tags"], books)


def lemma_frequency(tokens: DataFrame, books: DataFrame | None = None) -> DataFrame:
    return frequency(tokens, ["lemma"], books)


def head_sum(counts: DataFrame, lines: int, order: Sequence) -> DataFrame:
    """One row, the sum of n over the first lines of a list; over all of it if it is shorter."""
    return counts.orderBy(*order).limit(lines).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("head_sum"), F.count("*").alias("lines"))


def dictionary(tokens: DataFrame, assume_all_correct: bool = False, store_lemmas: bool = False) -> DataFrame:
    """(form, interps): the distinct tags of each form, sorted; unknown forms only if all are taken as correct."""
    known = tokens if assume_all_correct else tokens.where(~F.coalesce("unknown_form", F.lit(False)))
    tags = interp_str(F.col("interp"))
    entry = F.concat_ws(":", "lemma", tags) if store_lemmas else tags
    return known.where("form is not null").select("form", entry.alias("entry")).distinct().groupBy("form").agg(F.sort_array(F.collect_list("entry")).alias("interps"))


def subset_lengths(found: DataFrame, value: str) -> DataFrame:
    """Length of text by value of an attribute."""
    return found.groupBy(F.col(value).alias("value")).agg(F.sum("text_length").alias("text_length"), F.count("*").alias("n_sections"))


def by_subsets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts n by keys and, where counts has an array subsets, by each of them: what is equal but for that is counted before it is multiplied."""
    if "subsets" not in counts.columns:
        return counts
    return counts.withColumn("subset", F.explode("subsets")).groupBy("subset", *keys).agg(F.sum("n").alias("n"))


def held_subsets(df: DataFrame) -> list[str]:
    """The column that tells subsets apart, where df has one."""
    return [c for c in ("subset", "subsets") if c in df.columns]


def year_tokens(words: DataFrame) -> DataFrame:
    """([subset, ]year, n): tokens by year of their dated sections; of every subset, if words has an array subsets."""
    counted = words.where("date is not null").groupBy(*held_subsets(words), F.year("date").alias("year")).agg(F.count("*").alias("n"))
    return by_subsets(counted, ["year"])


def rule_lifetimes(rules: DataFrame) -> DataFrame:
    """([subset, ]rule, years, years_not): from a table ([subset, ]year, rule), the years in which a rule holds, and the other years that the table knows, sorted."""
    keys = held_subsets(rules)
    held = rules.where("rule is not null and year is not null").select(*keys, "rule", "year").distinct()
    years = held.select(*keys, "year").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("year")).alias("every"))  # calendar years: a few hundred
    by = held.groupBy(*keys, "rule").agg(F.sort_array(F.collect_list("year")).alias("years"))
    both = by.join(years, keys) if keys else by.crossJoin(F.broadcast(years))  # one row
    return both.select(*keys, "rule", "years", F.array_except("every", "years").alias("years_not"))


def rules_dropped(rules: DataFrame) -> DataFrame:
    """([subset, ]year, rule): rules of the year that the table knows before it, which no longer hold."""
    keys = held_subsets(rules)
    held = rules.where("rule is not null and year is not null").select(*keys, "rule", "year").distinct()
    years = held.select(*keys, "year").distinct()  # a few hundred rows of a subset
    following = years.select(*keys, "year", F.lead("year").over(Window.partitionBy(*keys).orderBy("year")).alias("next")).where("next is not null")
    return held.join(following, [*keys, "year"]).select(*keys, F.col("next").alias("year"), "rule").join(held, [*keys, "year", "rule"], "left_anti")
