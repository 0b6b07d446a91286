"""Commands: load, html-load, tag, run, search, dictionary, correct, score, tei, html, ids, decline, sumhead. See --help of each."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import editions, model
from .functions.classify import joined_lines, meta_reason, pertinent
from .functions.dates import earliest, extract_dates, to_date
from .functions.tokens import encoded, forms_text, interp_str, token_list
from .operators import collocations, correction, decisions, frequency, keywords, lattice, loader, score, search, subsets, tagging
from .sinks import files as sinks
from .sinks import tei
from .session import drop_written, written
from .sources import files, html


def _rows(loaded: DataFrame, config: dict, pages: bool, decided: DataFrame | None = None) -> DataFrame:
    """Sections as rows of an indexed edition: numbers, dates and pertinence as far as the text tells, then as it was decided."""
    par = lambda k: F.max(F.when(F.col("par_n") == k, F.col("text")))
    keys = ["edition", "section_n"]
    ordered = loaded.withColumn("_k", F.struct(*(["page_n", "par_n"] if pages else ["par_n"]))).withColumn("scan_page", F.col("page_n") if pages else F.lit(-1))
    placed = written(ordered.withColumn("par_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_k"))).drop("_k"), "placed")
    found = placed.select(*keys, "par_n", extract_dates("text").alias("d")).where(F.size("d") > 0)
    dates = found.groupBy(*keys).agg(F.min_by(F.when(F.col("par_n") == 1, earliest(F.col("d"))).otherwise(F.get("d", F.lit(0))), "par_n").alias("d"))
    about = placed.groupBy(*keys, "section_type").agg(F.count("*").alias("n"), par(1).alias("title"), par(2).alias("b"), par(3).alias("c"), F.min("scan_page").alias("start_page"), F.max("scan_page").alias("end_page"))
    known = F.when(F.col("section_type") == "document", pertinent(F.col("n"), F.col("b"), F.col("c"), F.col("title")) if pages else F.lit(True)).otherwise(False)
    sections = about.join(dates, keys, "left").select(
        *keys, "title", "start_page", "end_page", "section_type", F.when(F.col("section_type") == "document", to_date(F.col("d.day"), F.col("d.month"), F.col("d.year"))).alias("date"), known.alias("pertinence")
    )
    sections = loader.numbered(sections) if decided is None else decisions.apply_decisions(sections, decided)
    out = placed.drop("section_type").join(sections, keys)
    text = lambda key: F.lit(config.get(key)).cast("string")
    return out.select(
        text("book_title").alias("book_title"), "inbook_section_id", F.coalesce(F.col("inbook_document_id").cast("string"), F.lit("False")).alias("inbook_document_id"),
        "scan_page", "section_type", sinks.date_tuple(F.when(F.col("section_type") == "document", F.col("date"))).alias("section_date"),
        text("palatinate").alias("palatinate"), text("convent_location").alias("convent_location"), F.lit("False").alias("created_location"), text("default_convent_author").alias("author"),
        F.when(F.col("par_n") == 1, F.col("title")).otherwise(F.col("text")).alias("paragraph"),
        F.when((F.col("section_type") == "document") & F.col("pertinence"), "True").otherwise("False").alias("pertinence"), "par_n",
    )


def load(spark: SparkSession, args: argparse.Namespace) -> None:
    config = files.config(args.config)
    pages = files.pages(spark, config["path"], config.get("prefix", ""))
    lines, most = config.get("max_nonmeta_line_len", 200), config.get("max_heading_len", 300)
    parts = loader.page_paragraphs(loader.without_pages(pages, [tuple(r) for r in config.get("ignore_page_ranges", [])]), config.get("min_inparagraph_line_len"))
    found = loader.segment(parts, lines, most, config.get("heading_length_discount", 70))
    made = files.decisions(spark, args.decisions) if args.decisions else None
    found = loader.merge_short(found) if made is None else decisions.replay(found, made)
    sinks.indexed_csv(_rows(written(found, "loaded"), config, True, made), args.out)


def _named(name: str):
    """What a plug-in is called: module:function."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def tag(spark: SparkSession, args: argparse.Namespace) -> None:
    """Documents of an edition tagged by an engine, from a section on; notes stay as they are, or go."""
    rows = editions.paragraphs(spark, args.edition).where(F.col("section_n") >= args.start_section)
    document = F.col("section_type") == "document"
    text = F.col("paragraph") if args.leave_hyphens else joined_lines(F.col("paragraph"))
    given = rows.where(document & (F.trim(F.coalesce("paragraph", F.lit(""))) != "")).withColumn("paragraph", text)
    none = F.lit(False)
    token = encoded(F.col("form"), F.col("lemma"), F.col("interp"), none, none, none, none)
    each = tagging.tag(given, _named(args.engine)).select("section_id", "par_n", "sent_n", F.struct("tok_n", token.alias("t")).alias("t"))
    of = lambda c, between: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), between)
    sentences = each.groupBy("section_id", "par_n", "sent_n").agg(of("t", " ").alias("t")).groupBy("section_id", "par_n").agg(of(F.struct("sent_n", "t"), "\n").alias("_text"))
    tagged = given.join(sentences, ["section_id", "par_n"], "left").withColumn("paragraph", F.concat(F.coalesce("_text", F.lit("")), F.lit("\n"))).drop("_text")
    sinks.indexed_csv(tagged if args.strip_meta else tagged.unionByName(rows.where(~document)), args.out)


def decline(spark: SparkSession, args: argparse.Namespace) -> None:
    """Each lemma of a list with the forms that an engine declines it to."""
    lemmas = spark.read.text(args.lemmas).select(F.explode(F.split("value", r"\s+")).alias("lemma")).where("lemma <> ''")
    by = tagging.expand(lemmas, _named(args.engine)).groupBy("lemma").agg(F.array_sort(F.collect_set("form")).alias("forms"))
    by.orderBy("lemma").select(F.array_join("forms", " ").alias("value")).write.text(args.out)


def sum_head(spark: SparkSession, args: argparse.Namespace) -> None:
    """The sum of the last but one column over the first lines of a list; the whole sum of a shorter one."""
    lines = spark.read.text(args.path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    fields = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    print(frequency.head_sum(lines.select("at", F.try_element_at(fields, F.lit(-2)).try_cast("long").alias("n")), args.lines, ["at"]).first()["head_sum"])


def html_load(spark: SparkSession, args: argparse.Namespace) -> None:
    config = files.config(args.config)
    pages = spark.read.text(config["html_file_path"], wholetext=True).select(F.lit("e").alias("edition"), F.col("value").alias("html"))
    found = html.sections(pages, config["structure"], bool(config.get("text_section")), args.strip_ruthenian, config.get("max_nonmeta_line_len", 200), config.get("max_heading_len", 300))
    sinks.indexed_csv(_rows(written(found, "loaded"), config, False), args.out)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """The methods over every subset, each result a folder; tokens are decoded once for all."""
    found, rows = editions.listed(spark, args.list)
    if args.weights:
        weights = spark.createDataFrame(list(files.config(args.weights).items()), "palatinate string, weight double")
        drawn = subsets.weighted_sample(found, weights, seed=args.seed).select("section_id")
        found, rows = found.join(drawn, "section_id", "left_semi"), rows.join(drawn, "section_id", "left_semi")
    every = subsets.by_attribute(editions.tokens(rows))
    if args.ranges:
        span = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(files.config(args.ranges))], "range_n int, range_start string, range_end string")
        index = subsets.subset_index(found, span).where("subset like 'date_range__%'")
        every = every.unionByName(editions.tokens(rows).join(index, "section_id"))
    body = model.body(every)
    lemmas = model.unabbreviated(body)
    save = lambda name, df, *by: sinks.results(df, f"{args.out}/{name}", by or ("subset",))
    save("basic_stats", frequency.basic_stats(every))
    save("form_frequency", frequency.form_frequency(body))
    save("lemma_frequency", frequency.lemma_frequency(lemmas))
    span = span if args.ranges else spark.createDataFrame([], "range_n int, range_start string, range_end string")
    of = subsets.subset_index(found, span).groupBy("section_id").agg(F.collect_set("subset").alias("subsets"))
    plain = editions.tokens(rows).join(of, "section_id")
    forms, corpus = model.body(plain).withColumn("tags", interp_str(F.col("interp"))), model.unabbreviated(model.body(plain))
    kw = files.keyword_files(spark, args.keywords) if args.keywords else None
    for size, name in ((2, "bigrams"), (3, "trigrams")):
        for kind, tokens, fields in (("form", forms, ["form", "lemma", "tags"]), ("lemma", corpus, ["lemma"])):
            save(f"{kind}_{name}", collocations.collocations(tokens, fields, size, by_subset=True))
            if kw is not None:
                for category in [r[0] for r in kw.select("keyword_category").distinct().collect()]:
                    save(f"keywords_{kind}_{name}/{category}", keywords.keyword_collocations(tokens, kw, category, fields, size, by_subset=True))
    if kw is not None:
        counts = lemmas.groupBy("subset", "lemma").agg(F.count("*").alias("n"))
        save("keyword_dist", keywords.keyword_report(keywords.keyword_distribution(counts, kw)))
        years = keywords.group_years(corpus.where("date is not null"), kw, args.first_year, args.last_year)
        save("group_years", years, "subset", "keyword_group")
        lives = frequency.rule_lifetimes(years.select("subset", "year", F.col("keyword_group").alias("rule")))
        joined = lambda c: F.array_join(F.transform(c, lambda y: y.cast("string")), ":").alias(c)
        save("rule_lifetimes", lives.select("subset", "rule", joined("years"), joined("years_not")))
    save("year_tokens", frequency.year_tokens(corpus))


def find(spark: SparkSession, args: argparse.Namespace) -> None:
    found, rows = editions.listed(spark, args.list)
    patterns = [p for p in args.patterns if not p.startswith("DR:")]
    span = [p for p in args.patterns if p.startswith("DR:")]
    if len(span) > 1:
        raise SystemExit("more than one date range given")
    if span:
        rows = rows.where(search.within(F.col("date"), span[0]))
    hits = search.concordance(editions.tokens(rows), patterns).join(found.select("section_id", "title", "date", "book_title"), "section_id").orderBy("section_id", "par_n", "tok_n")
    n = 0
    for r in hits.select(forms_text(token_list(F.col("title"))).alias("title"), F.year("date").alias("year"), "book_title", "before", "match", "after").toLocalIterator():
        n += 1
        print(f"{r.title} ({r.year or '?'}), {r.book_title}\n{r.before} [{r.match}] {r.after}")
    print(f"{n} matches found.")


def make_dictionary(spark: SparkSession, args: argparse.Namespace) -> None:
    _, rows = editions.listed(spark, args.list)
    sinks.dictionary(frequency.dictionary(editions.tokens(rows), args.assume_all_correct, args.store_lemmas), args.out)


def correct(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = editions.paragraphs(spark, args.edition)
    fixed = correction.correct_tokens(editions.tokens(rows), files.dictionary(spark, args.dictionary), args.use_lemmas)
    token = encoded(*[F.col(c) for c in ("form", "lemma", "interp", "latin", "proper_name", "unknown_form", "corrected")])
    text = fixed.withColumn("coded", token).groupBy("section_id", "par_n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_n", "coded"))), lambda x: x["coded"]), " ").alias("_text"))
    out = rows.join(text, ["section_id", "par_n"], "left").withColumn("paragraph", F.when(F.col("section_type") == "document", F.coalesce("_text", F.lit(""))).otherwise(F.col("paragraph")))
    sinks.indexed_csv(out.drop("_text"), args.out)


def rate(spark: SparkSession, args: argparse.Namespace) -> None:
    pages = files.config(args.config).get("dev__true_document_pages")
    if not pages:
        raise SystemExit("no true pages in the config")
    documents = editions.sections(editions.paragraphs(spark, args.edition)).where("section_type = 'document'")
    found = documents.select(F.lit("e").alias("edition"), F.col("section_id").alias("document_n"), "text_length")
    truth = spark.createDataFrame([("e", n, x) for n, x in enumerate(score.true_lengths(pages))], "edition string, document_n int, pages int")
    row = score.indexing_scores(found, truth).first()
    if row is None or row["distance"] is None:
        raise SystemExit("fewer than half as many documents as in the truth are not scored")
    print(json.dumps({k: row[k] for k in ("distance", "difference", "score")}))


def _whole(rows: DataFrame) -> DataFrame:
    texts = F.transform(F.sort_array(F.collect_list(F.struct("par_n", F.col("scan_page").cast("int").alias("page"), F.coalesce("paragraph", F.lit("")).alias("text")))), lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text")))
    gathered = rows.groupBy("section_id").agg(texts.alias("paragraphs"), F.min(F.col("inbook_document_id").try_cast("int")).alias("document_id"))
    return editions.sections(rows).join(gathered, "section_id")


def _parsed(raw: DataFrame, tagged: DataFrame) -> DataFrame:
    """(section_id, parsed): of each paragraph the sentences of its tokens, with their places in the raw text."""
    keys = ["section_id", "par_n"]
    listed = tagged.select(*keys, token_list(F.col("paragraph")).alias("t"))
    both = raw.select(*keys, F.coalesce("paragraph", F.lit("")).alias("raw")).join(listed, keys)
    placed = tagging.transfer_spaces(both.select(*keys, "raw", F.transform("t", lambda t: t["form"]).alias("forms"))).where("offset >= 0")
    tokens = listed.select(*keys, F.posexplode("t").alias("tok_n", "t")).join(placed.select(*keys, "tok_n", "offset"), [*keys, "tok_n"])
    at = lattice.split_sentences(tokens.select(F.struct(*keys).alias("par"), F.col("tok_n").alias("pos_n"), (F.col("t.form") == ".").alias("is_stop"), F.array_contains("t.interp", "brev").alias("is_brev"), "t", "offset"))
    interp = F.struct(F.col("t.lemma").alias("base"), F.coalesce(F.get("t.interp", F.lit(0)), F.lit("")).alias("ctag"), F.array_join(F.slice("t.interp", F.lit(2), F.greatest(F.size("t.interp") - 1, F.lit(0))), ":").alias("msd"))
    token = F.struct("pos_n", F.struct(F.col("t.form").alias("orth"), "offset", F.array(interp).alias("interps")).alias("t"))
    gathered = lambda c, name: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]).alias(name)
    sentences = at.groupBy("par", "sent_n").agg(gathered(token, "t")).groupBy("par").agg(gathered(F.struct("sent_n", "t"), "t")).select("par.*", "t")
    empty = F.array().cast(sentences.schema["t"].dataType)
    every = raw.select(*keys).join(sentences, keys, "left").select(*keys, F.coalesce("t", empty).alias("t"))
    return every.groupBy("section_id").agg(gathered(F.struct("par_n", "t"), "parsed"))


def write_tei(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = editions.paragraphs(spark, args.edition)
    one = _whole(rows).where("n_paragraphs > 1 or section_type = 'meta'")
    cols = one.select("section_id", "book_title", "section_n", "section_type", "document_id", "title", F.col("date").cast("string").alias("date"), "convent_location", "paragraphs")
    if args.tagged:
        documents = F.col("section_type") == "document"
        cols = cols.join(_parsed(rows.where(documents), editions.paragraphs(spark, args.tagged).where(documents)), "section_id", "left")
    sinks.save_texts(tei.corpus_files(cols, files.config(args.config), args.corpus), args.out, "xml")


def write_html(spark: SparkSession, args: argparse.Namespace) -> None:
    one = _whole(editions.paragraphs(spark, args.edition)).withColumn("edition", F.lit("e")).withColumn("paragraphs", F.transform("paragraphs", lambda p: p["text"]))
    report = sinks.html_report(one.withColumn("reason", meta_reason(F.get("paragraphs", F.lit(0)))))
    report.orderBy("section_n").select("html").write.text(args.out)


def ids(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = editions.paragraphs(spark, args.edition)
    found = editions.sections(rows).join(rows.groupBy("section_id").agg(F.first("inbook_document_id").alias("inbook_document_id")), "section_id")
    sinks.document_ids(found, args.out)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="laudarium", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, do, *positional: str, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for x, kind in options.items():
            p.add_argument("--" + x.replace("_", "-"), **kind)
        p.set_defaults(do=do)
        return p

    flag = {"action": "store_true"}
    command("load", load, "config", "out", decisions={})
    command("html-load", html_load, "config", "out", strip_ruthenian=flag)
    command("tag", tag, "edition", "out", engine={"required": True}, strip_meta=flag, leave_hyphens=flag, start_section={"type": int, "default": 0})
    command("decline", decline, "lemmas", "out", engine={"required": True})
    command("sumhead", sum_head, "path").add_argument("lines", type=int)
    command("run", run, "list", "out", keywords={}, ranges={}, weights={}, seed={"type": int, "default": 1}, first_year={"type": int, "default": 1572}, last_year={"type": int, "default": 1696})
    command("search", find, "list").add_argument("patterns", nargs="+")
    command("dictionary", make_dictionary, "list", "out", assume_all_correct=flag, store_lemmas=flag)
    command("correct", correct, "edition", "dictionary", "out", use_lemmas=flag)
    command("score", rate, "config", "edition")
    command("tei", write_tei, "config", "edition", "out", corpus={"default": "corpus"}, tagged={})
    command("html", write_html, "edition", "out")
    command("ids", ids, "edition", "out")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("laudarium").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        args.do(spark, args)
    finally:
        drop_written(spark)


if __name__ == "__main__":
    main()
