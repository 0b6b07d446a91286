"""Frequency of every term, counted in two ways: heavy terms in local arrays, the rest by a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .tokens import delivered_once, spelled

#: Heavy terms that are counted in local arrays. A section's heavy terms are one BIGINT of bits.
HEAVY = 64
#: A task's sections with bits before it passes them on.
SECTIONS_HELD = 200_000


_COUNTED = "section_id long, term_field string, term string, slot int, n long, bits long"
_FIELDS = ("form", "lemma")


def _counted(heavy: dict[tuple[str, str], int]):
    """Tokens (section_id, form, lemma) to counts, each token spelled once.

    Heavy terms add to the task's counter array and, by section, to the bits of its heavy terms; other terms leave
    as (section_id, term_field, term, n), put together within a batch.
    """

    def rows(**given: pa.Array) -> pa.RecordBatch:
        size = len(next(iter(given.values())))
        kinds = {"section_id": pa.int64(), "term_field": pa.string(), "term": pa.string(), "slot": pa.int32(), "n": pa.int64(), "bits": pa.int64()}
        return pa.RecordBatch.from_arrays([given[k].cast(t) if k in given else pa.nulls(size, t) for k, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(HEAVY, np.int64)
        bits: dict[int, int] = {}

        def sections() -> pa.RecordBatch:
            out = rows(section_id=pa.array(bits.keys(), pa.int64()), bits=pa.array(np.array(list(bits.values()), np.uint64).view(np.int64)))
            bits.clear()
            return out

        for batch in batches:
            ids = batch.column("section_id").dictionary_encode()
            no_section = len(ids.dictionary)
            at = ids.indices.fill_null(no_section).to_numpy(zero_copy_only=False).astype(np.int64)
            named = pa.concat_arrays([ids.dictionary, pa.nulls(1, pa.int64())])
            held = np.zeros(no_section + 1, np.uint64)
            for field in _FIELDS:
                coded = batch.column(field).dictionary_encode()
                terms = [spelled(w) for w in coded.dictionary.to_pylist()] + [None]
                slots = np.array([-2 if t is None else heavy.get((field, t), -1) for t in terms])
                word = coded.indices.fill_null(len(terms) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                slot = slots[word]
                some = slot >= 0
                counts += np.bincount(slot[some], minlength=HEAVY)
                np.bitwise_or.at(held, at[some], np.uint64(1) << slot[some].astype(np.uint64))
                rest = slot == -1
                pairs, n = np.unique(at[rest] * len(terms) + word[rest], return_counts=True)
                if len(pairs):
                    said = pa.array(terms, pa.string()).take(pa.array(pairs % len(terms)))
                    yield rows(section_id=named.take(pa.array(pairs // len(terms))), term_field=pa.array([field] * len(pairs), pa.string()), term=said, n=pa.array(n))
            for k in np.flatnonzero(held[:-1]).tolist():
                section = ids.dictionary[k].as_py()
                bits[section] = bits.get(section, 0) | int(held[k])
            if len(bits) >= SECTIONS_HELD:
                yield sections()
        if bits:
            yield sections()
        used = np.flatnonzero(counts)
        if len(used):
            yield rows(slot=pa.array(used), n=pa.array(counts[used]))

    return run


def use_class(n_sections: Column, all_sections: Column, rare_below: int, common_share: tuple[int, int]) -> Column:
    part, whole = common_share
    return F.when(n_sections < rare_below, "rare").when(n_sections * whole >= all_sections * part, "common").otherwise("useful")


def term_frequency(tokens: DataFrame, rare_below: int = 3, common_share: tuple[int, int] = (2, 5)) -> DataFrame:
    """(term_field, term, n_tokens, n_sections, use_class) of every form and lemma.

    The 64 most used terms are estimated by a sketch over all rows; the estimate only decides how a term is
    counted. Heavy terms are counted exactly in an array of each task, their sections as bits of one number
    by section; other terms are shuffled by term and section, pre-aggregated. Both tables are then united. One
    pass over the tokens makes both, and is written.

    Null and blank forms or lemmas are no terms. A token without section_id counts as a token, in no
    section. Copies of a token count once. An empty table gives no rows; other columns are ignored.
    """
    spark = tokens.sparkSession
    raw = tokens.select(F.expr("stack(2, 'form', form, 'lemma', lemma) as (term_field, word)")).where("word is not null")
    top = raw.agg(F.expr(f"approx_top_k(term_field || ':' || lower(word), {HEAVY}, 10000)").alias("top"))  # an estimate needs no exact spelling
    total = tokens.agg(F.count_distinct("section_id").alias("all_sections"))
    named = [(field, spelled(word)) for field, word in (x["item"].split(":", 1) for x in (top.first()["top"] or []))]
    keys = list(dict.fromkeys(k for k in named if k[1]))
    heavy = spark.createDataFrame([(f, t, i) for i, (f, t) in enumerate(keys)], "term_field string, term string, slot int")
    counted = written(delivered_once(tokens).select("section_id", *_FIELDS).mapInArrow(_counted({(f, t): i for i, (f, t) in enumerate(keys)}), _COUNTED), "counted")

    light = (
        counted.where("term is not null")
        .groupBy("term_field", "term", "section_id").agg(F.sum("n").alias("n"))
        .groupBy("term_field", "term").agg(F.sum("n").alias("n_tokens"), F.count("section_id").alias("n_sections"))
    )
    n_tokens = counted.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n_tokens"))
    by_section = counted.where("bits is not null").groupBy("section_id").agg(F.bit_or("bits").alias("bits"))
    n_sections = by_section.agg(
        F.array(*[F.coalesce(F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(1)), F.lit(0)) for i in range(HEAVY)]).alias("held")
    ).select(F.posexplode("held").alias("slot", "n_sections"))
    heavy_counts = F.broadcast(heavy).join(n_tokens, "slot").join(n_sections, "slot").select("term_field", "term", "n_tokens", "n_sections")
    return (
        light.unionByName(heavy_counts)
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("use_class", use_class(F.col("n_sections"), F.col("all_sections"), rare_below, common_share))
        .drop("all_sections")
    )


def found(tokens: DataFrame) -> DataFrame:
    """The terms that too few or too many sections use."""
    return term_frequency(tokens).where("use_class <> 'useful'").select("term_field", "term", "use_class")
