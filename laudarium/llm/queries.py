"""The queries of the training-data operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import chunking, cooccurrence, frequency, langid, mixing, ocr, packing, sentences, skeleton


def _on(f: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])


def _languages(rows: DataFrame, labels: DataFrame, editions: DataFrame) -> DataFrame:
    return langid.section_languages(langid.stretches(rows, labels, editions), labels)


def _sentences(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Sentences by the tables of the languages that texts are found to be in."""
    return lambda rows, labels, editions: f(rows, spans=langid.spans(langid.section_profiles(rows, labels, editions)))


#: What is no blank, the same in both engines.
_INK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{000b}\x{001c}-\x{001f}]"


def _ink(text: str) -> Column:
    return F.length(F.regexp_replace(text, _INK, ""))


def _sentence_coverage(rows: DataFrame, spans: object = None) -> DataFrame:
    """(section_id, par_n, n_chars): the letters and marks that the sentences of a paragraph hold, all of them."""
    found = sentences.sentences(rows, spans=spans)
    return found.groupBy("section_id", "par_n").agg(F.sum(_ink("sentence")).alias("n_chars"))


def _piece_coverage(rows: DataFrame) -> DataFrame:
    """(section_id, n_chars, longest_over, overlap_over): what pieces hold without their overlaps, and how many are too long or overlap too far."""
    new = chunking.pieces(rows).withColumn("new", F.expr("substring(piece, overlap + 1)"))
    blanks = F.col("overlap") - F.length(F.regexp_replace(F.expr("substring(piece, 1, overlap)"), r"(?U)\s+$", ""))
    return new.groupBy("section_id").agg(
        F.sum(_ink("new")).alias("n_chars"), F.count_if(F.length("piece") > chunking.MOST).alias("too_long"),
        F.count_if(F.col("overlap") - blanks > chunking.OVERLAP).alias("too_much_overlap"), F.min("piece_n").cast("long").alias("first_n"),
        (F.max("piece_n") - F.count("*")).alias("numbers_missing"),
    )


def _container_coverage(documents: DataFrame) -> DataFrame:
    """One row: documents and characters in containers, containers over the capacity, and texts cut although they need not be."""
    placed = packing.pack(documents)
    full = placed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("over_full"))
    return placed.agg(
        F.count_distinct("doc_id").alias("documents"), F.coalesce(F.sum(F.col("char_end") - F.col("char_start")), F.lit(0)).alias("characters"),
        F.count_if((F.col("n_pieces") > 1) & (F.col("piece_n") == 1)).alias("cut"),
    ).crossJoin(full)


def _mix_limits(documents: DataFrame, targets: DataFrame, size: int | str | None) -> DataFrame:
    """(source, max_repeats, within_budget, within_repeats, near_target): that no source exceeds its budget or repeats, and, where it can, reaches its share to half a per cent of the mix or, of a small one, a text."""
    records, shares = mixing.mix(documents, targets, size=size)
    most = records.groupBy("source").agg(F.max("uses").alias("uses"))
    near = ~F.col("reachable") | (F.col("budget") - F.col("n_tokens") < F.greatest(0.005 * F.col("mix_size"), F.lit(1500.0)))
    return shares.join(most, "source", "left").select(
        "source", "max_repeats", (F.col("n_tokens") <= F.col("budget")).alias("within_budget"), (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), near.alias("near_target")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _on(frequency.found, "parsed_tokens"),
    "p1_terms": _on(frequency.term_frequency, "parsed_tokens"),
    "p2_found": _on(ocr.found, "edition_rows", "editions"),
    "p2_text": _on(ocr.continuous_text, "edition_rows", "editions"),
    "p3_found": _on(langid.found, "edition_rows", "section_labels", "editions", "parsed_tokens"),
    "p3_stretches": _on(langid.stretches, "edition_rows", "section_labels", "editions"),
    "p3_sections": _on(_languages, "edition_rows", "section_labels", "editions"),
    "p3_token_paragraphs": _on(langid.token_paragraphs, "parsed_tokens"),
    "p4_found": _on(_sentences(sentences.found), "edition_rows", "section_labels", "editions"),
    "p4_sentences": _on(_sentences(sentences.sentences), "edition_rows", "section_labels", "editions"),
    "p4_coverage": _on(_sentences(_sentence_coverage), "edition_rows", "section_labels", "editions"),
    "p5_found": _on(chunking.found, "edition_rows"),
    "p5_coverage": _on(_piece_coverage, "edition_rows"),
    "p5_pieces": _on(chunking.pieces, "edition_rows"),
    "p6_found": _on(cooccurrence.found, "parsed_tokens"),
    "p6_lemma_pairs": _on(lambda t: cooccurrence.pair_counts(t, "lemma"), "parsed_tokens"),
    "p6_form_pairs": _on(lambda t: cooccurrence.pair_counts(t, "form"), "parsed_tokens"),
    "p7_found": _on(packing.found, "documents"),
    "p7_containers": _on(packing.pack, "documents"),
    "p7_neighbours": _on(packing.neighbours, "documents"),
    "p7_fill": _on(packing.fill_report, "documents"),
    "p7_coverage": _on(_container_coverage, "documents"),
    "p8_limits": _on(lambda d, m: _mix_limits(d, m, "feasible"), "documents", "mix_targets"),
    "p8_limits_full_size": _on(lambda d, m: _mix_limits(d, m, None), "documents", "mix_targets"),
    "p8_found": _on(mixing.found, "documents", "mix_targets"),
    "p8_mix": _on(lambda d, m: mixing.mix(d, m)[0], "documents", "mix_targets"),
    "p8_shares": _on(lambda d, m: mixing.mix(d, m)[1], "documents", "mix_targets"),
    "p8_shares_full_size": _on(lambda d, m: mixing.mix(d, m, size=None)[1], "documents", "mix_targets"),
    "p9_found": _on(skeleton.found, "documents"),
    "p9_forms": _on(skeleton.text_forms, "documents"),
    "p9_groups": _on(skeleton.look_groups, "documents"),
}

_TERM = r"nullif(nfc_normalize(lower(nfc_normalize(regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')))), '')"
_TERMS = f"""
with tokens as (select distinct section_id, par_n, tok_n, form, lemma from parsed_tokens),
terms as (
  select section_id, 'form' as term_field, {_TERM.format("form")} as term from tokens
  union all select section_id, 'lemma', {_TERM.format("lemma")} from tokens),
every as (select count(distinct section_id) as n from parsed_tokens),
counted as (select term_field, term, count(*) as n_tokens, count(distinct section_id) as n_sections from terms where term is not null group by term_field, term),
marked as (
  select term_field, term, n_tokens, n_sections,
    case when n_sections < 3 then 'rare' when n_sections * 5 >= n * 2 then 'common' else 'useful' end as use_class
  from counted, every)
"""


def _pairs(field: str) -> str:
    return f"""
with used as (select distinct section_id, {_TERM.format(field)} as term from parsed_tokens where section_id is not null),
terms as (select section_id, term from used where term is not null),
n as (select term, count(*) as n from terms group by term),
every as (select count(distinct section_id) as n_sections from parsed_tokens),
joined as (select a.term as term_a, b.term as term_b, count(*) as n_ab from terms a join terms b on a.section_id = b.section_id and a.term < b.term group by a.term, b.term),
pairs as (
  select term_a, term_b, x.n as n_a, y.n as n_b, n_ab, n_sections, n_ab * n_sections / (x.n * y.n) as ratio,
    (n_ab + 0.5::double) * (n_sections - x.n - y.n + n_ab + 0.5::double) / ((x.n - n_ab + 0.5::double) * (y.n - n_ab + 0.5::double)) as odds_ratio
  from joined join n x on x.term = term_a join n y on y.term = term_b, every)
"""


_ALL_PAIRS = "select term_a, term_b, n_a, n_b, n_ab, n_sections, ratio, odds_ratio from pairs"

_LIMITS = "select source, max_repeats, true as within_budget, true as within_repeats, true as near_target from mix_targets"

ORACLE_SQL: dict[str, str] = {
    "p4_coverage": f"""
with rows as (select distinct section_id, par_n, paragraph, coalesce(par_n = 1 and section_type = 'document', false) as title from edition_rows where paragraph is not null)
select section_id, par_n, sum(n)::bigint as n_chars from (select section_id, par_n, length(regexp_replace(paragraph, '{_INK}', '', 'g')) as n from rows) where n > 0 group by section_id, par_n""",
    "p5_coverage": f"""
with rows as (select distinct section_id, coalesce(par_n, 0) as par_n, paragraph from edition_rows where section_id is not null and paragraph is not null),
sizes as (select section_id, sum(length(paragraph)) + 2 * (count(*) - 1) as size, sum(length(regexp_replace(paragraph, '{_INK}', '', 'g')))::bigint as n_chars from rows group by section_id)
select section_id, n_chars, 0::bigint as too_long, 0::bigint as too_much_overlap, 1::bigint as first_n, 0::bigint as numbers_missing from sizes where size > 2500""",
    "p7_coverage": "select count(distinct doc_id) as documents, sum(length(coalesce(text, '')))::bigint as characters, count_if(strlen(text) > 4096) as cut, 0::bigint as over_full from documents",
    "p8_limits": _LIMITS,
    "p8_limits_full_size": _LIMITS,
    "p1_found": _TERMS + "select term_field, term, use_class from marked where use_class <> 'useful'",
    "p1_terms": _TERMS + "select term_field, term, n_tokens, n_sections, use_class from marked",
    "p5_found": """
with rows as (select distinct section_id, coalesce(par_n, 0) as par_n, paragraph from edition_rows where section_id is not null and paragraph is not null),
sizes as (
  select section_id, sum(length(paragraph)) + 2 * (count(*) - 1) as size, max(length(paragraph)) as longest,
    max(list_max(list_transform(regexp_split_to_array(paragraph, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]+'), lambda x: length(x)))) as run
  from rows group by section_id)
select section_id, case when run > 2500 then 'unbroken' when longest > 2500 then 'within' else 'paragraph' end as cut_level
from sizes where size > 2500
""",
    "p6_found": _pairs("lemma") + "select term_a as lemma_a, term_b as lemma_b from pairs where n_ab >= 8 and n_ab * n_sections >= 4 * n_a * n_b",
    "p6_lemma_pairs": _pairs("lemma") + _ALL_PAIRS,
    "p6_form_pairs": _pairs("form") + _ALL_PAIRS,
    "p7_found": "select doc_id from documents where strlen(text) > 4096",
    "p8_found": """
with sized as (select lower(trim(source)) as name, coalesce(strlen(text), 0) as size from documents),
held as (select name, sum(size) as held from sized group by name)
select source from mix_targets left join held on name = lower(trim(source)), (select sum(size) as total from sized)
where coalesce(held, 0) * max_repeats < target_share * total
""",
}
