"""All queries of the library over the project's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import editions, model
from ..functions import classify, dates
from ..functions import tokens as codec
from ..operators import collocations, correction, decisions, frequency, keywords, lattice, loader, review, score, search, subsets
from ..session import new_path, table
from ..sinks import files as sinks
from .sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def _on(f: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])


def _corpus(parsed: DataFrame) -> DataFrame:
    """Tokens without titles and abbreviations: the lemma corpus."""
    return model.unabbreviated(model.body(model.tokens(parsed)))


def _words(rows: DataFrame) -> DataFrame:
    """(section_id, date, lemma): the words of dated pertinent documents, without titles and outer marks, in lower case."""
    own = model.body(model.documents_only(model.paragraphs(rows))).where("date is not null")
    words = own.select("section_id", "date", F.explode(classify.words(F.col("paragraph"))).alias("word"))
    return words.select("section_id", "date", F.lower(F.regexp_replace("word", r"^[.,;:!?()]+|[.,;:!?()]+$", "")).alias("lemma")).where("lemma <> ''")


def _forms(parsed: DataFrame) -> DataFrame:
    """Tokens without titles, with their tags as a string: the form corpus."""
    return model.body(model.tokens(parsed)).withColumn("tags", codec.interp_str(F.col("interp")))


def _with_subsets(tokens: DataFrame, editions: DataFrame) -> DataFrame:
    """Tokens with the array of the subsets that their book is in."""
    books = editions.select("book_title", "palatinate", "convent_location").dropDuplicates(["book_title"])
    return tokens.join(books, "book_title", "left").withColumn("subsets", subsets.attribute_keys())


def _grams(corpus: Callable[[DataFrame], DataFrame], fields: list[str], size: int) -> Query:
    return _on(lambda p, e: collocations.collocations(_with_subsets(corpus(p), e), fields, size, by_subset=True), "parsed_tokens", "editions")


def _kw_grams(corpus: Callable[[DataFrame], DataFrame], fields: list[str], size: int) -> Query:
    return _on(lambda p, e, k: keywords.every_keyword_collocations(_with_subsets(corpus(p), e), k, fields, size, by_subset=True), "parsed_tokens", "editions", "keyword_lemmas")


def _token_codec(parsed: DataFrame) -> DataFrame:
    coded = model.tokens(parsed).withColumn("coded", codec.encoded(*[F.col(c) for c in ("form", "lemma", "interp", "latin", "proper_name", "unknown_form", "corrected")]))
    t = codec.decoded(F.col("coded"))
    return coded.select("section_id", "par_n", "tok_n", "coded", t["form"].alias("form"), t["lemma"].alias("lemma"), codec.interp_str(t["interp"]).alias("tags"), t["latin"].alias("latin"), t["proper_name"].alias("proper_name"), t["unknown_form"].alias("unknown_form"), t["corrected"].alias("corrected"))


def _paragraph_tokens(parsed: DataFrame) -> DataFrame:
    """Paragraphs as token strings, read back: forms in order and how many tokens there are."""
    t = model.tokens(parsed).withColumn("coded", codec.encoded(F.regexp_replace(F.coalesce("form", F.lit("")), r"(?U)\s+", ""), F.regexp_replace(F.coalesce("lemma", F.lit("")), r"(?U)\s+", ""), F.col("interp"), F.col("latin"), F.col("proper_name"), F.col("unknown_form"), F.col("corrected")))
    text = t.groupBy("section_id", "par_n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_n", "coded"))), lambda x: x["coded"]), " ").alias("text"))
    return text.select("section_id", "par_n", F.size(codec.token_list(F.col("text"))).alias("n_tokens"), codec.forms_text(codec.token_list(F.col("text"))).alias("forms"))


def _head_sum(parsed: DataFrame, editions: DataFrame) -> DataFrame:
    counts = frequency.lemma_frequency(model.tokens(parsed).transform(model.body).withColumn("subset", F.lit("ALL")))
    return frequency.head_sum(counts, 100, [F.desc("n"), "first_section", "first_par", "first_tok"])


def _distribution(parsed: DataFrame, editions: DataFrame, kw: DataFrame) -> DataFrame:
    return keywords.keyword_distribution(frequency.counts(_corpus(parsed), ["lemma"], editions), kw)


def _rules(rows: DataFrame, kw: DataFrame) -> DataFrame:
    """(year, rule): the keyword groups that occur in a year, the table that lifetimes are taken of."""
    return keywords.group_years(_words(rows), kw).select("year", F.col("keyword_group").alias("rule"))


def _words_of_subsets(rows: DataFrame, date_ranges: DataFrame) -> DataFrame:
    """_words with the array of the subsets that their section is in, date ranges among them."""
    of = subsets.subset_index(model.documents_only(model.sections(rows)), date_ranges).groupBy("section_id").agg(F.array_sort(F.collect_set("subset")).alias("subsets"))
    return _words(rows).join(of, "section_id")


def _lifetimes(rules: DataFrame) -> DataFrame:
    """Lifetimes with years as they are written."""
    found = frequency.rule_lifetimes(rules)
    years = lambda c: F.array_join(F.transform(c, lambda y: y.cast("string")), ":").alias(c)
    return found.select(*[c for c in found.columns if c == "subset"], "rule", years("years"), years("years_not"))


def _edition(rows: DataFrame) -> DataFrame:
    """Scanned paragraphs as an edition's own: edition, page_n, par_n, text."""
    scans = model.paragraphs(rows).where("scan_page >= 0 and paragraph is not null")
    return scans.select(F.col("book_title").alias("edition"), F.col("scan_page").alias("page_n"), F.struct("section_id", "par_n").alias("par_n"), F.col("paragraph").alias("text"))


def _segmented(rows: DataFrame) -> DataFrame:
    p = _edition(rows)
    return loader.segment(p.withColumn("text", F.trim(classify.ocr_corrected(F.col("text")))).where("text <> ''"))


def _plain_places(found: DataFrame) -> DataFrame:
    return found.select("edition", "section_n", "section_type", "page_n", "par_n.section_id", "par_n.par_n", "text")


def _split_lines(rows: DataFrame) -> DataFrame:
    p = _edition(rows)
    return loader.page_paragraphs(p.select(F.concat_ws("#", "edition", F.col("par_n").cast("string")).alias("edition"), "page_n", "text"), 30)


def _meta(rows: DataFrame) -> DataFrame:
    return model.paragraphs(rows).select("section_id", "par_n", classify.meta_reason(F.col("paragraph")).alias("reason")).distinct().where("reason is not null")


def _headings(rows: DataFrame, editions: DataFrame) -> DataFrame:
    limits = editions.groupBy("book_title").agg(F.max("max_heading_len").alias("most"))
    scored = model.paragraphs(rows).join(limits, "book_title", "left")
    return scored.select("section_id", "par_n", F.round(classify.heading_score(F.col("paragraph"), F.coalesce("most", F.lit(300))), 6).alias("score"), F.round(classify.beginning_score(F.col("paragraph")), 6).alias("beginning")).distinct()


def _titles(rows: DataFrame) -> DataFrame:
    """Of the first three paragraphs the best heading; the first of equals."""
    first = model.paragraphs(rows).where("par_n <= 3 and paragraph is not null")
    best = F.max(F.struct(classify.heading_score(F.col("paragraph")).alias("score"), (-F.col("par_n")).alias("order"), "paragraph"))
    return first.groupBy("section_id").agg(best.alias("b")).select("section_id", F.col("b.paragraph").alias("title"))


def _pertinence(rows: DataFrame) -> DataFrame:
    par = lambda k: F.max(F.when(F.col("par_n") == k, F.col("paragraph")))
    by = model.paragraphs(rows).groupBy("section_id").agg(F.count("*").alias("n"), par(2).alias("second"), par(3).alias("third"))
    return by.join(_titles(rows), "section_id", "left").select("section_id", classify.pertinent(F.col("n"), F.col("second"), F.col("third"), F.col("title")).alias("pertinent"))


def _guessed_dates(rows: DataFrame) -> DataFrame:
    """The earliest date of the title, else the first one of the text, paragraph by paragraph."""
    found = model.paragraphs(rows).where("par_n is not null").select("section_id", "par_n", dates.extract_dates("paragraph").alias("found")).where(F.size("found") > 0)
    pick = F.when(F.col("par_n") == 1, dates.earliest(F.col("found"))).otherwise(F.get("found", F.lit(0)))
    return found.groupBy("section_id").agg(F.min_by(pick, "par_n").alias("d")).select("section_id", dates.to_date(F.col("d.day"), F.col("d.month"), F.col("d.year")).cast("string").alias("date"))


def _islands(rows: DataFrame) -> DataFrame:
    """Consecutive rows of a book as delivered with one section number are one section, however often the number comes again."""
    flat = rows.select(F.struct("book_title").alias("book"), "book_title", "row_id", "section_id")  # a struct is not null
    by = loader.islands(flat, ["book"], "row_id", "section_id")
    return by.groupBy("book_title", "island_n").agg(F.max("section_id").alias("section_id"), F.count("*").alias("n_rows"))


def _round_trip(rows: DataFrame) -> DataFrame:
    """The edition written as an indexed CSV and read again: its sections, told apart by their numbers alone, and their paragraphs."""
    spark = rows.sparkSession
    path = new_path(spark, "edition")
    sinks.indexed_csv(model.paragraphs(rows).where("section_id is not null and par_n is not null").withColumn("inbook_section_id", F.col("section_id")), path)
    back = editions.paragraphs(spark, path)
    return back.select("section_n", "par_n", F.col("inbook_section_id").cast("long").alias("number"), "book_title", F.col("scan_page").cast("int").alias("scan_page"), F.coalesce("paragraph", F.lit("")).alias("paragraph"), F.col("date").cast("string").alias("date"))


def _sections(rows: DataFrame) -> DataFrame:
    return model.sections(rows).select("section_id", "book_title", "section_type", F.col("date").cast("string").alias("date"), "n_paragraphs", "text_length")


def _pages(rows: DataFrame) -> DataFrame:
    by = model.paragraphs(rows).groupBy("section_id")
    return by.agg(F.min_by("scan_page", "par_n").alias("start_page"), F.max_by("scan_page", "par_n").alias("end_page"))


def _first_paragraphs(rows: DataFrame) -> DataFrame:
    """The collapsed text of the first two paragraphs."""
    p = model.paragraphs(rows).where("par_n <= 2")
    return p.groupBy("section_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("par_n", F.coalesce("paragraph", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def _renumbered(rows: DataFrame) -> DataFrame:
    s = model.sections(rows).where("book_title is not null")
    return loader.renumber(s.select(F.col("book_title").alias("edition"), F.col("section_id").alias("section_n"), "section_type"))


def _decided(rows: DataFrame) -> DataFrame:
    """Sections after decisions that take receipts, wherever they stand in a scanned book, as not pertinent."""
    s = model.sections(rows).join(_titles(rows), "section_id").join(_pages(rows), "section_id")
    own = s.select(F.col("book_title").alias("edition"), F.col("section_id").alias("section_n"), "title", "start_page", "end_page", "section_type", "date", (F.col("pertinence") == "True").alias("pertinence"))
    title = F.coalesce("title", F.lit(""))
    none = F.lit(None)
    made = own.where("start_page >= 0 and title like 'Pokwitowanie%'").select(
        F.lit(0).alias("decision_n"), F.lit("pertinence").alias("decision_type"), F.col("start_page").alias("pagenum"), title.alias("from_title"), none.cast("string").alias("to_title"),
        none.cast("string").alias("section_type"), F.lit(False).alias("pertinence_status"), none.cast("struct<day:int,month:int,year:int>").alias("date"),
    )
    return decisions.apply_decisions(own, made).select("section_n", "edition", "pertinence", F.col("date").cast("string").alias("date"), "inbook_section_id", "inbook_document_id")


def _correct(parsed: DataFrame) -> DataFrame:
    tokens = model.tokens(parsed)
    known = frequency.dictionary(tokens.where("form is not null"))
    return correction.correct_tokens(tokens, known).where("corrected").select("section_id", "par_n", "tok_n", "form", "lemma", "unknown_form", "corrected")


def _variants(parsed: DataFrame) -> DataFrame:
    """Each place of a paragraph as a position of a lattice."""
    t = model.tokens(parsed).where("par_n is not null and tok_n is not null")
    arcs = t.select(F.struct("section_id", "par_n").alias("sent"), (F.col("tok_n") - 1).alias("start"), F.col("tok_n").alias("end"), F.col("form").alias("orth"), F.col("lemma").alias("base"), codec.interp_str(F.col("interp")).alias("tag"), F.lit(0).alias("arc_n"))
    return lattice.weighted_arcs(arcs).groupBy("sent").agg(F.count("*").alias("arcs"), F.sum("prob").alias("prob"), F.max(F.when(F.col("eos") == "eos", F.col("end"))).alias("last")).select("sent.section_id", "sent.par_n", "arcs", "prob", "last")


def _token_sentences(parsed: DataFrame) -> DataFrame:
    t = model.tokens(parsed)
    places = t.select(F.struct("section_id", "par_n").alias("par"), F.col("tok_n").alias("pos_n"), (F.col("form") == ".").alias("is_stop"), F.array_contains("interp", "brev").alias("is_brev"))
    return lattice.split_sentences(places).groupBy("par", "sent_n").agg(F.count("*").alias("n_tokens")).select("par.section_id", "par.par_n", "sent_n", "n_tokens")


def _scores(rows: DataFrame) -> DataFrame:
    """Scanned books as segment_documents tells their documents apart, against the pages on which their own documents begin."""
    own = model.documents_only(model.sections(rows)).join(_pages(rows), "section_id").where("book_title is not null and start_page >= 0")
    truth = score.page_lengths(own.select(F.col("book_title").alias("edition"), F.col("section_id").alias("document_n"), "start_page"))
    documents = _segmented(rows).where("section_type = 'document'").groupBy("edition", F.col("section_n").alias("document_n")).agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("text_length"))
    return score.indexing_scores(documents, truth).select("edition", F.round("distance", 6).alias("distance"), "difference", F.round("score", 6).alias("score"))


def _document_ids(rows: DataFrame) -> DataFrame:
    return model.sections(rows).where("section_type = 'document'").join(_titles(rows), "section_id", "left").select("section_id", "title", (F.col("pertinence") == "True").alias("pertinence"))


def _html(rows: DataFrame) -> DataFrame:
    """Every section of the edition, its paragraphs in order; notes have the reason of their first paragraph."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("par_n", F.coalesce("paragraph", F.lit("")).alias("text")))), lambda x: x["text"])
    gathered = model.paragraphs(rows).groupBy("section_id").agg(texts.alias("paragraphs"))
    s = model.sections(rows).join(gathered, "section_id").join(_titles(rows), "section_id", "left")
    return sinks.html_report(s.select(F.col("book_title").alias("edition"), F.col("section_id").alias("section_n"), "section_type", "title", classify.meta_reason(F.get("paragraphs", F.lit(0))).alias("reason"), "paragraphs"))


QUERIES: dict[str, Query] = {
    "token_codec": _on(_token_codec, "parsed_tokens"),
    "paragraph_tokens": _on(_paragraph_tokens, "parsed_tokens"),
    "basic_stats": _on(lambda p, e: frequency.basic_stats(model.tokens(p), e), "parsed_tokens", "editions"),
    "form_frequency": _on(lambda p, e: frequency.form_frequency(model.body(model.tokens(p)), e), "parsed_tokens", "editions"),
    "lemma_frequency": _on(lambda p, e: frequency.lemma_frequency(_corpus(p), e), "parsed_tokens", "editions"),
    "head_sum": _on(_head_sum, "parsed_tokens", "editions"),
    "form_bigrams": _on(lambda p: collocations.collocations(model.body(model.tokens(p)).withColumn("tags", codec.interp_str(F.col("interp"))), ["form", "lemma", "tags"], 2), "parsed_tokens"),
    "form_trigrams": _on(lambda p: collocations.collocations(model.body(model.tokens(p)).withColumn("tags", codec.interp_str(F.col("interp"))), ["form", "lemma", "tags"], 3), "parsed_tokens"),
    "lemma_bigrams": _on(lambda p: collocations.collocations(_corpus(p), ["lemma"], 2), "parsed_tokens"),
    "lemma_trigrams": _on(lambda p: collocations.collocations(_corpus(p), ["lemma"], 3), "parsed_tokens"),
    "lemma_bigrams_in_paragraphs": _on(lambda p: collocations.collocations(_corpus(p), ["lemma"], 2, "paragraph"), "parsed_tokens"),
    "kw_lemma_bigrams": _on(lambda p, k: keywords.keyword_collocations(_corpus(p), k, "money", ["lemma"], 2), "parsed_tokens", "keyword_lemmas"),
    "kw_lemma_trigrams": _on(lambda p, k: keywords.keyword_collocations(_corpus(p), k, "money", ["lemma"], 3), "parsed_tokens", "keyword_lemmas"),
    "kw_form_bigrams": _on(lambda p, k: keywords.keyword_collocations(model.body(model.tokens(p)).withColumn("tags", codec.interp_str(F.col("interp"))), k, "money", ["form", "lemma", "tags"], 2), "parsed_tokens", "keyword_lemmas"),
    "kw_form_trigrams": _on(lambda p, k: keywords.keyword_collocations(model.body(model.tokens(p)).withColumn("tags", codec.interp_str(F.col("interp"))), k, "money", ["form", "lemma", "tags"], 3), "parsed_tokens", "keyword_lemmas"),
    "kw_lemma_bigrams_by_category": _on(lambda p, k: keywords.every_keyword_collocations(_corpus(p), k, ["lemma"], 2), "parsed_tokens", "keyword_lemmas"),
    "kw_lemma_trigrams_by_category": _on(lambda p, k: keywords.every_keyword_collocations(_corpus(p), k, ["lemma"], 3), "parsed_tokens", "keyword_lemmas"),
    "kw_form_bigrams_by_category": _on(lambda p, k: keywords.every_keyword_collocations(_forms(p), k, ["form", "lemma", "tags"], 2), "parsed_tokens", "keyword_lemmas"),
    "kw_form_trigrams_by_category": _on(lambda p, k: keywords.every_keyword_collocations(_forms(p), k, ["form", "lemma", "tags"], 3), "parsed_tokens", "keyword_lemmas"),
    "form_bigrams_by_subset": _grams(_forms, ["form", "lemma", "tags"], 2),
    "kw_form_bigrams_by_subset": _kw_grams(_forms, ["form", "lemma", "tags"], 2),
    "form_trigrams_by_subset": _grams(_forms, ["form", "lemma", "tags"], 3),
    "kw_form_trigrams_by_subset": _kw_grams(_forms, ["form", "lemma", "tags"], 3),
    "lemma_bigrams_by_subset": _grams(_corpus, ["lemma"], 2),
    "kw_lemma_bigrams_by_subset": _kw_grams(_corpus, ["lemma"], 2),
    "lemma_trigrams_by_subset": _grams(_corpus, ["lemma"], 3),
    "kw_lemma_trigrams_by_subset": _kw_grams(_corpus, ["lemma"], 3),
    "keyword_groups": _on(keywords.groups, "keyword_lemmas"),
    "keyword_distribution": _on(_distribution, "parsed_tokens", "editions", "keyword_lemmas"),
    "keyword_report": _on(lambda p, e, k: keywords.keyword_report(_distribution(p, e, k)), "parsed_tokens", "editions", "keyword_lemmas"),
    "kw_group_years": _on(lambda r, k: keywords.group_years(_words(r), k), "edition_rows", "keyword_lemmas"),
    "year_tokens": _on(lambda r: frequency.year_tokens(_words(r)), "edition_rows"),
    "rule_lifetimes": _on(lambda r, k: _lifetimes(_rules(r, k)), "edition_rows", "keyword_lemmas"),
    "year_tokens_by_subset": _on(lambda r, d: frequency.year_tokens(_words_of_subsets(r, d)), "edition_rows", "date_ranges"),
    "kw_group_years_by_subset": _on(lambda r, d, k: keywords.group_years(_words_of_subsets(r, d), k), "edition_rows", "date_ranges", "keyword_lemmas"),
    "rule_lifetimes_by_subset": _on(lambda r, d, k: _lifetimes(keywords.group_years(_words_of_subsets(r, d), k).withColumnRenamed("keyword_group", "rule")), "edition_rows", "date_ranges", "keyword_lemmas"),
    "rules_dropped": _on(lambda r, k: frequency.rules_dropped(_rules(r, k)), "edition_rows", "keyword_lemmas"),
    "dictionary": _on(lambda p: frequency.dictionary(model.tokens(p)).select("form", F.array_join("interps", "|").alias("interps")), "parsed_tokens"),
    "correct_tokens": _on(_correct, "parsed_tokens"),
    "subset_lengths": _on(lambda r: frequency.subset_lengths(model.documents_only(model.sections(r)), "palatinate"), "edition_rows"),
    "subset_index": _on(lambda r, d: subsets.subset_index(model.documents_only(model.sections(r)), d), "edition_rows", "date_ranges"),
    "weighted_sample": _on(lambda r, w: subsets.weighted_sample(model.documents_only(model.sections(r)), w), "edition_rows", "palatinate_weights"),
    "lexeme_search": _on(lambda p: search.lexeme_search(model.tokens(p), ["RE:^w", "RE:."]), "parsed_tokens"),
    "concordance": _on(lambda p: search.concordance(model.tokens(p), ["poseł"], 5), "parsed_tokens"),
    "sections": _on(_sections, "edition_rows"),
    "section_pages": _on(_pages, "edition_rows"),
    "first_paragraphs": _on(_first_paragraphs, "edition_rows"),
    "section_islands": _on(_islands, "edition_rows"),
    "indexed_round_trip": _on(_round_trip, "edition_rows"),
    "renumbered": _on(_renumbered, "edition_rows"),
    "ocr_correct": _on(lambda r: model.paragraphs(r).select("section_id", "par_n", classify.ocr_corrected(F.col("paragraph")).alias("text")).distinct(), "edition_rows"),
    "match_keys": _on(lambda r: model.paragraphs(r).select("section_id", "par_n", classify.match_key(F.col("paragraph")).alias("match_key")).distinct(), "edition_rows"),
    "joined_lines": _on(lambda r: model.paragraphs(r).select("section_id", "par_n", classify.joined_lines(F.col("paragraph")).alias("text")).distinct(), "edition_rows"),
    "meta_fragments": _on(_meta, "edition_rows"),
    "heading_scores": _on(_headings, "edition_rows", "editions"),
    "titles": _on(_titles, "edition_rows"),
    "pertinence": _on(_pertinence, "edition_rows"),
    "extract_dates": _on(lambda r: model.paragraphs(r).select("section_id", "par_n", F.explode(dates.extract_dates("paragraph")).alias("d")).select("section_id", "par_n", "d.day", "d.month", "d.year").distinct(), "edition_rows"),
    "guessed_dates": _on(_guessed_dates, "edition_rows"),
    "split_short_lines": _on(_split_lines, "edition_rows"),
    "segment_documents": _on(lambda r: _plain_places(_segmented(r)), "edition_rows"),
    "merge_short": _on(lambda r: _plain_places(loader.merge_short(_segmented(r))), "edition_rows"),
    "decided_sections": _on(_decided, "edition_rows"),
    "lattice_arcs": _on(_variants, "parsed_tokens"),
    "token_sentences": _on(_token_sentences, "parsed_tokens"),
    "indexing_scores": _on(_scores, "edition_rows"),
    "document_ids": _on(_document_ids, "edition_rows"),
    "html_report": _on(_html, "edition_rows"),
    "near_sections": _on(lambda r: review.near(model.sections(r).select(F.col("section_id").alias("section_n"), "section_type", "n_paragraphs"), 100), "edition_rows"),
}

ORACLE_SQL: dict[str, str] = {name: sql for name, sql in SQL.items() if name in QUERIES}
