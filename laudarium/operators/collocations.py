"""Bigrams and trigrams with Jaccard and likelihood ratio, over a corpus as one sequence or paragraph by paragraph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..numbering import dense_ids
from ..session import written


def _sequence(tokens: DataFrame, fields: Sequence[str], size: int, boundary: str, by_subset: bool = False) -> DataFrame:
    """(w1, w2[, w3]) of all places; the last ones of a paragraph go on in the next if boundary is corpus.

    Neighbours within a paragraph are found by windows over the paragraph. For the places at its end,
    paragraphs get consecutive numbers and meet the first tokens of the next two, so the corpus is never one
    window. A place with too few followers has nulls. By subset, a sequence is what a subset holds, and places
    come out with each of their subsets: within a paragraph they are the same, so only its ends are multiplied.
    """
    held, keys = (["subsets"], ["subset"]) if by_subset else ([], [])
    spread = lambda df: df.withColumn("subset", F.explode("subsets")).drop("subsets") if by_subset else df
    token = F.struct(*fields)
    order = Window.partitionBy("section_id", "par_n").orderBy("tok_n", *fields)
    placed = tokens.select(*held, "section_id", "par_n", "tok_n", *fields).withColumn("w1", token)
    for k in range(1, size):
        placed = placed.withColumn(f"w{k + 1}", F.lead("w1", k).over(order))
    if boundary == "paragraph":
        return spread(placed.select(*held, *[f"w{k + 1}" for k in range(size)]))
    all_of = Window.partitionBy("section_id", "par_n")
    marked = placed.withColumn("from_start", F.row_number().over(order)).withColumn("from_end", F.count("*").over(all_of) - F.col("from_start") + 1)
    heads = spread(marked.where("from_start <= 2")).groupBy(*keys, "section_id", "par_n").agg(
        F.max(F.when(F.col("from_start") == 1, F.col("w1"))).alias("h1"), F.max(F.when(F.col("from_start") == 2, F.col("w1"))).alias("h2")
    )
    numbered = dense_ids(heads.withColumn("at", F.struct(*keys, "section_id", "par_n")), "at", "id").drop("at")
    one = numbered.select(*keys, (F.col("id") - 1).alias("id"), F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    two = numbered.select(*keys, (F.col("id") - 2).alias("id"), F.col("h1").alias("b1"))
    after = numbered.select(*keys, "section_id", "par_n", "id").join(one, [*keys, "id"], "left").join(two, [*keys, "id"], "left").drop("id")
    ends = spread(marked.where(F.col("from_end") < size)).join(after, [*keys, "section_id", "par_n"], "left")
    second = F.coalesce("w2", "a1")
    if size == 2:
        tail = ends.select(*keys, "w1", second.alias("w2"))
    else:
        third = F.when(F.col("from_end") == 2, F.col("a1")).otherwise(F.coalesce("a2", "b1"))
        tail = ends.select(*keys, "w1", second.alias("w2"), third.alias("w3"))
    inner = spread(marked.where(F.col("from_end") >= size).select(*held, *[f"w{k + 1}" for k in range(size)]))
    return inner.unionByName(tail)


def _term(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)


def _marked(counts: DataFrame, names: Sequence[str], fields: Sequence[str], marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """counts (keys, names, n) of words, for each category that marks a lemma in them: with placeholders as words, added up."""
    for w in names:
        counts = counts.join(marks.select(F.col("lemma").alias("_lemma"), F.col("placeholders").alias(f"m_{w}")), F.col(w)["lemma"] == F.col("_lemma"), "left").drop("_lemma")
    of = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(f"m_{w}"), F.array().cast("array<string>")) for w in names])))
    by = counts.withColumn("keyword_category", F.explode(of))
    put = lambda w: F.struct(*[(F.coalesce(F.try_element_at(f"m_{w}", F.col("keyword_category")), F.col(w)[f]) if f in ("form", "lemma") else F.col(w)[f]).alias(f) for f in fields])
    return by.select(*keys, "keyword_category", *[put(w).alias(w) for w in names], "n").groupBy(*keys, "keyword_category", *names).agg(F.sum("n").alias("n"))


def _with_count(out: DataFrame, plain: DataFrame, marked: DataFrame | None, keys: Sequence[str], words: dict[str, str], name: str) -> DataFrame:
    """out with the count of words (column of out: column of plain) as name; a category's own count, if it has placeholders in them."""
    cols = [F.col(b).alias(a) for a, b in words.items()]
    out = out.join(plain.select(*keys, *cols, F.col("n").alias(name)), [*keys, *words], "left")
    if marked is None:
        return out
    own = marked.select(*keys, "keyword_category", *cols, F.col("n").alias("_own"))
    return out.join(own, [*keys, "keyword_category", *words], "left").withColumn(name, F.coalesce("_own", name)).drop("_own")


def collocations(tokens: DataFrame, fields: Sequence[str], size: int = 2, boundary: str = "corpus", placeholders: bool = False, least: int = 2, shortest: int = 2, marks: DataFrame | None = None, by_subset: bool = False) -> DataFrame:
    """(w1_*, w2_*[, w3_*], n, jaccard, likelihood_ratio), most frequent first, ties by the words.

    fields are the columns of a word, the first its form or lemma. N-grams count from `least` on, if no word
    is shorter than `shortest`; with placeholders one word must be a group's. The counts of words, and of
    pairs for trigrams, are those of the whole corpus. Null fields compare as the empty string.

    Jaccard is n over all places that hold any of the words where the n-gram has it; the likelihood ratio is
    twice the sum of observed times the logarithm of observed over expected, over the contingency table.

    marks (lemma, placeholders: category to placeholder) asks for the n-grams that hold a keyword group, of
    every category by itself, as if its placeholders stood in the corpus; keyword_category comes first. The
    corpus is counted once: a lemma decides what a word is replaced by, so counts are, not tokens.

    by_subset asks for the n-grams of every subset by itself, with its own counts and total; tokens have an
    array subsets, the same for all of a section, and subset comes first.
    """
    keys = ["subset"] if by_subset else []
    plain = tokens.select(*(["subsets"] if by_subset else []), "section_id", "par_n", "tok_n", *[F.coalesce(f, F.lit("")).alias(f) for f in fields])
    grams = _sequence(plain, fields, size, boundary, by_subset)
    if size == 3 or marks is not None or by_subset:
        grams = written(grams, "grams")  # counted up to three times; the plan would outgrow the driver
    names = [f"w{k + 1}" for k in range(size)]
    counted = grams.where(F.col(names[-1]).isNotNull()).groupBy(*keys, *names).agg(F.count("*").alias("n"))
    if marks is not None:
        counted = _marked(counted, names, fields, marks, keys)
    own = [*keys, *(["keyword_category"] if marks is not None else [])]
    kept = counted.where(F.col("n") >= least)
    for w in names:
        kept = kept.where(F.length(F.col(w)[fields[0]]) >= shortest)
    if placeholders:
        mark = [F.startswith(F.col(w)[fields[-1] if len(fields) == 1 else fields[1]], F.lit("__")) for w in names]
        kept = kept.where(mark[0] | mark[1] if size == 2 else mark[0] | mark[1] | mark[2])
    each = plain.withColumn("subset", F.explode("subsets")) if by_subset else plain
    single = each.select(*keys, F.struct(*fields).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("n"))
    total = each.groupBy(*keys).agg(F.count("*").cast("double").alias("total"))
    single_marked = None if marks is None else _marked(single, ["w"], fields, marks, keys)
    out = kept
    for w in names:
        out = _with_count(out, single, single_marked, keys, {w: "w"}, f"n_{w}")
    out = out.join(total, "subset") if by_subset else out.crossJoin(F.broadcast(total))  # one row
    d = lambda c: F.col(c).cast("double")
    if size == 2:
        a, b, c = d("n"), d("n_w2") - d("n"), d("n_w1") - d("n")
        rest = F.col("total") - a - b - c
        cells = [(a, d("n_w1") * d("n_w2")), (b, (F.col("total") - d("n_w1")) * d("n_w2")), (c, d("n_w1") * (F.col("total") - d("n_w2"))), (rest, (F.col("total") - d("n_w1")) * (F.col("total") - d("n_w2")))]
        llr = sum((_term(o, e / F.col("total")) for o, e in cells), F.lit(0.0)) * 2
        jaccard = a / (a + b + c)
    else:
        for x, y in ((1, 2), (1, 3), (2, 3)):
            a, b = ("w1", "w3") if y - x == 2 else ("w1", "w2")
            pair = grams.where(F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count("*").alias("n"))
            pair_marked = None if marks is None else _marked(pair, [a, b], fields, marks, keys)
            out = _with_count(out, pair, pair_marked, keys, {f"w{x}": a, f"w{y}": b}, f"n_{x}{y}").na.fill(0, [f"n_{x}{y}"])
        iii, ii_, i_i, _ii = d("n"), d("n_12"), d("n_13"), d("n_23")
        t = F.col("total")
        table = {
            (1, 1, 1): iii, (0, 1, 1): _ii - iii, (1, 0, 1): i_i - iii, (1, 1, 0): ii_ - iii,
        }
        table[1, 0, 0] = d("n_w1") - iii - table[1, 0, 1] - table[1, 1, 0]
        table[0, 1, 0] = d("n_w2") - iii - table[0, 1, 1] - table[1, 1, 0]
        table[0, 0, 1] = d("n_w3") - iii - table[0, 1, 1] - table[1, 0, 1]
        held = sum(table.values(), F.lit(0.0))
        table[0, 0, 0] = t - held
        margin = lambda k, bit: d(f"n_w{k + 1}") if bit else t - d(f"n_w{k + 1}")
        llr = sum((_term(o, margin(0, k[0]) * margin(1, k[1]) * margin(2, k[2]) / (t * t)) for k, o in table.items()), F.lit(0.0)) * 2
        jaccard = iii / held
    words = [F.col(w)[f].alias(f"{w}_{f}") for w in names for f in fields]
    return out.select(*own, *words, "n", F.round(jaccard, 6).alias("jaccard"), F.round(llr, 4).alias("likelihood_ratio")).orderBy(*own, F.desc("n"), *[f"{w}_{f}" for w in names for f in fields])
