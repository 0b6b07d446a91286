"""Languages of sections, paragraphs and stretches of text, with a confidence; wrong and missing labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..session import written
from .hyper import DIMENSIONS, KEPT, Profiles, confidence, fitted, words
from .ocr import HYPHENS, line_kind, scanned
from .sentences import sentence_starts
from .tokens import TOKENS_PER_BLOCK

LANGUAGES = ("pl", "la", "de", "fr", "uk", "hy", "zh")
# Three-letter codes of the labels.
CODES = {"pol": "pl", "lat": "la", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "ukr": "uk", "hye": "hy", "arm": "hy", "zho": "zh", "chi": "zh"}
#: The sample that profiles are made of: sections of a language, paragraphs of a section, characters of a paragraph.
SECTIONS, PARAGRAPHS, CHARACTERS = 150, 20, 2000
#: Words (of Chinese, characters) that make a stretch.
STRETCH = 6
#: A run of STRETCH words in a sentence that speaks so much more for another language has the sentence divided.
STRANGE, CHANGE = 4.0, 1.5
#: Below this a whole paragraph is of one language.
FAMILIAR = 1.0

_WORDS = re.compile(r"[㐀-鿿]|[^\W\d_]+")
_JOINED = re.compile(rf"(?<=\w)[{re.escape(HYPHENS)}]\s*\n\s*(?=[^\W\d_])")


def label_names(label: Column) -> Column:
    """The languages that a label names, as two-letter codes; an empty array if it says nothing."""
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    parts = F.transform(F.split(F.lower(F.coalesce(label, F.lit(""))), r"\+"), lambda x: F.trim(F.split(x, "[-_]")[0]))
    named = F.transform(parts, lambda x: F.coalesce(F.try_element_at(codes, x), x))
    return F.array_distinct(F.filter(named, lambda x: x.isin(*LANGUAGES)))


def _plain(text: str, title: str | None, page: int | None, scan: bool) -> str:
    if scan:
        lines = [x for x in text.split("\n") if x.strip() and not any(line_kind(x, title, page))]
        text = _JOINED.sub("", "\n".join(lines))
    return text.replace("\n", " ")


@arrow_udf(T.StringType())
def _text_of(texts: pa.Array, titles: pa.Array, pages: pa.Array, scans: pa.Array) -> pa.Array:
    return pa.array(map(_plain, texts.to_pylist(), titles.to_pylist(), pages.to_pylist(), scans.to_pylist()), pa.string())


def _paragraphs(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """(section_id, par_n, paragraph, book_title, page, scan) without copies."""
    keep = ["section_id", "par_n", "paragraph", "book_title"]
    scans = scanned(rows, editions).select(*keep, "page", F.lit(True).alias("scan"))
    other = rows.where("paragraph is not null and (scan_page < 0 or scan_page is null)").select(*keep[:3]).distinct()
    return scans.unionByName(other.withColumns({"book_title": F.lit(None).cast("string"), "page": F.lit(None).cast("int"), "scan": F.lit(False)}))


def plain_text(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """(section_id, par_n, text) without copies; scanned rows without header and number lines, their lines joined."""
    return _paragraphs(rows, editions).select("section_id", "par_n", _text_of("paragraph", "book_title", "page", "scan").alias("text"))


def section_profiles(rows: DataFrame, labels: DataFrame, editions: DataFrame) -> Profiles:
    """Profiles from a bounded sample: for each language the SECTIONS sections with the smallest hash whose label names it alone."""
    named = labels.where("section_id is not null").select("section_id", label_names(F.col("lang_label")).alias("named")).where(F.size("named") == 1).select("section_id", F.col("named")[0].alias("lang"))
    by_hash = F.struct(F.xxhash64("section_id").alias("hash"), "section_id")
    picked = None
    for lang in LANGUAGES:
        some = named.where(F.col("lang") == lang).orderBy(by_hash).limit(SECTIONS)
        picked = some if picked is None else picked.unionByName(some)
    picked = written(picked, "picked")
    text = plain_text(rows.where(F.col("par_n") <= PARAGRAPHS).join(picked, "section_id", "left_semi"), editions)
    sample = text.join(picked, "section_id").select("lang", F.substring("text", 1, CHARACTERS).alias("text")).collect()
    out = []
    for r in sample:
        starts = sentence_starts(r["text"])
        out += [(r["lang"], r["text"][a:b]) for a, b in zip(starts, [*starts[1:], len(r["text"])])]
    return fitted(out, LANGUAGES)


def _n_words(text: str, lang: str) -> int:
    return len(re.findall(r"[㐀-鿿]", text)) if lang == "zh" else sum(1 for w in text.split() if w.isalnum() or any(map(str.isalnum, w)))


def _states(said: np.ndarray) -> list[int]:
    """The language of each word: the best way through the words, where a change of language costs CHANGE."""
    best, back = said[0].copy(), []
    for s in said[1:]:
        change = best.max() - CHANGE
        back.append(np.where(best >= change, np.arange(len(best)), int(best.argmax())))
        best = np.maximum(best, change) + s
    of = [int(best.argmax())]
    for b in reversed(back):
        of.append(int(b[of[-1]]))
    return of[::-1]


def _strange(sums: np.ndarray, main: int) -> float:
    """How much more some run of STRETCH words speaks for another language than for the main one."""
    if len(sums) <= STRETCH + 1:
        return 0.0
    runs = sums[STRETCH:] - sums[:-STRETCH]
    return float((runs.max(axis=1) - runs[:, main]).max())


def _parts(text: str, places: list[tuple[int, int]], sums: np.ndarray) -> list[list[int]]:
    """(start, end, language, first word, last word + 1) of a text of several languages: sentence by sentence, and within a sentence where a run is strange."""
    starts = sentence_starts(text)
    parts: list[list[int]] = []

    def add(a: int, b: int, k: int, i: int, j: int) -> None:
        if parts and (k == -1 or parts[-1][2] in (k, -1)):
            parts[-1] = [parts[-1][0], b, max(k, parts[-1][2]), parts[-1][3], j]
        else:
            parts.append([a, b, k, i, j])

    i = 0
    for a, b in zip(starts, [*starts[1:], len(text)]):
        j = i
        while j < len(places) and places[j][0] < b:
            j += 1
        if i == j:
            add(a, b, -1, i, j)
            continue
        own = sums[i : j + 1]
        main = int((own[-1] - own[0]).argmax())
        if _strange(own, main) <= STRANGE * _UNIT:
            add(a, b, main, i, j)
        else:
            at, from_ = a, i
            of = _states(np.diff(own, axis=0) / _UNIT)
            for n in range(1, len(of) + 1):
                if n == len(of) or of[n] != of[n - 1]:
                    end = b if n == len(of) else places[i + n][0]
                    add(at, end, of[n - 1], from_, i + n)
                    at, from_ = end, i + n
        i = j
    return parts


def stretches_of(text: str, profiles: Profiles) -> list[tuple[int, int, str, int, float]]:
    """(start, end, lang, words, confidence) of the stretches of one language; what has no words goes with what is before it.

    A text none of whose runs of words is strange to its language is one stretch; only others are taken apart.
    """
    said = _WORDS.findall(text.lower())
    if not said:
        return []
    rows = profiles.rows(said)
    totals = np.zeros((len(rows) + 1, rows.shape[1]))
    np.cumsum(rows, axis=0, out=totals[1:])
    main = int(totals[-1, :-1].argmax())
    if _strange(totals[:, :-1], main) <= FAMILIAR * _UNIT:
        lang = profiles.languages[main]
        return [(0, len(text), lang, _n_words(text, lang), confidence(profiles.cosines(totals[-1], len(said))))]
    places = [m.span() for m in _WORDS.finditer(text)]
    if len(places) != len(said):  # a letter whose small form is not one letter
        totals = np.vstack([np.zeros(rows.shape[1]), np.cumsum(profiles.rows([text[a:b].lower() for a, b in places]), axis=0)])
    out = []
    for a, b, k, i, j in _parts(text, places, totals[:, :-1]):
        if k >= 0:
            lang = profiles.languages[k]
            out.append((a, b, lang, _n_words(text[a:b], lang), confidence(profiles.cosines(totals[j] - totals[i], j - i))))
    return out


def spans(profiles: Profiles):
    """A function of a text: (start, end, lang) of its stretches of one language."""

    def of(text: str) -> list[tuple[int, int, str]]:
        return [x[:3] for x in stretches_of(text, profiles)]

    return of


def _stretches(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _COLUMNS]
            for section, par, *given in zip(*(c.to_pylist() for c in batch.columns)):
                for n, row in enumerate(stretches_of(_plain(*given), profiles), 1):
                    for column, x in zip(out, (section, par, n, *row)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _COLUMNS.values())], names=list(_COLUMNS))

    return run


_COLUMNS = {"section_id": pa.int64(), "par_n": pa.int32(), "stretch_n": pa.int32(), "start": pa.int32(), "end": pa.int32(), "lang": pa.string(), "n_words": pa.int32(), "confidence": pa.float64()}
_UNIT = DIMENSIONS**0.5
_STRETCH = "section_id long, par_n int, stretch_n int, start int, end int, lang string, n_words int, confidence double"


def stretches(rows: DataFrame, labels: DataFrame, editions: DataFrame) -> DataFrame:
    """(section_id, par_n, stretch_n, start, end, lang, n_words, confidence): every paragraph as stretches of one language.

    Places are those in the plain text, of scanned rows without headers and numbers. Null, empty and wordless
    paragraphs have no stretches; rows without section or place are taken as they are; copies count once.
    """
    given = _paragraphs(rows, editions).where("paragraph <> ''").select("section_id", "par_n", "paragraph", "book_title", "page", "scan")
    return given.mapInArrow(_stretches(section_profiles(rows, labels, editions)), _STRETCH)


def section_languages(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(section_id, lang, n_words, share, confidence, label): the languages of each section beside its label."""
    by = found.groupBy("section_id", "lang").agg(F.sum("n_words").alias("n_words"), (F.sum(F.col("confidence") * F.col("n_words")) / F.greatest(F.sum("n_words"), F.lit(1))).alias("confidence"))
    total = by.groupBy("section_id").agg(F.sum("n_words").alias("all"))
    said = labels.where("section_id is not null").groupBy("section_id").agg(F.max("lang_label").alias("label"))
    return by.join(total, "section_id").join(said, "section_id", "left").select("section_id", "lang", "n_words", (F.col("n_words") / F.greatest("all", F.lit(1))).alias("share"), "confidence", "label")


def _token_score(profiles: Profiles):
    @arrow_udf(T.DoubleType())
    def score(forms: pa.Array) -> pa.Array:
        coded, known = forms.dictionary_encode(), profiles.kept
        of = []
        for f in coded.dictionary.to_pylist():
            if (x := known.get(f)) is None:
                if len(known) > KEPT:
                    known.clear()
                total = profiles.rows(words(f)).sum(axis=0)
                x = known[f] = float(total[0] - total[1])
            of.append(x)
        return pa.array(of, pa.float64()).take(coded.indices).fill_null(0.0)

    return score


def token_paragraphs(tokens: DataFrame) -> DataFrame:
    """(section_id, par_n, lang, confidence, n_tokens, n_wrong): the language, pl or la, of each tagged paragraph and its tokens whose latin flag is null or does not fit.

    Profiles come from a bounded sample, first by the greater part of a paragraph's flags. The products of
    words with the profiles add up, so a paragraph is only sums, however long. Copies count once. A paragraph
    without any word is pl with confidence 0.
    """
    keys = ["section_id", "par_n", "_block", "tok_n", "form", "lemma", "latin"]
    once = (
        tokens.select("section_id", "par_n", "tok_n", "form", "lemma", "latin").withColumn("_block", F.expr(f"tok_n div {TOKENS_PER_BLOCK}"))
        .repartition("section_id", "par_n", "_block").dropDuplicates(keys)
    )
    some = tokens.where("section_id is not null").select("section_id").distinct().orderBy(F.xxhash64("section_id"), "section_id").limit(4 * SECTIONS)
    sample = (
        tokens.where((F.col("par_n") <= PARAGRAPHS) & (F.col("tok_n") <= CHARACTERS // 10)).join(some, "section_id", "left_semi")
        .groupBy("section_id", "par_n").agg(F.array_join(F.collect_list("form"), " ").alias("text"), F.count_if("latin").alias("yes"), F.count_if(~F.col("latin")).alias("no"))
        .where("yes <> no").select(F.when(F.col("yes") > F.col("no"), "la").otherwise("pl").alias("lang"), "text").collect()
    )
    profiles = fitted([(r["lang"], r["text"]) for r in sample], ("pl", "la"))
    by = once.groupBy("section_id", "par_n").agg(
        F.sum(_token_score(profiles)("form")).alias("score"), F.count("*").alias("n_tokens"),
        F.count_if("latin").alias("yes"), F.count_if(~F.col("latin")).alias("no"), F.sum(F.length("form")).alias("size"),
    )
    lang = F.when(F.col("score") < 0, "la").otherwise("pl")
    wrong = F.col("n_tokens") - F.when(F.col("score") < 0, F.col("yes")).otherwise(F.col("no"))
    sure = F.coalesce(F.tanh(F.abs("score") / F.greatest(F.sqrt(F.col("size") * 3.0 * DIMENSIONS), F.lit(1.0))), F.lit(0.0))
    return by.select("section_id", "par_n", lang.alias("lang"), sure.alias("confidence"), "n_tokens", wrong.alias("n_wrong"))


def found(rows: DataFrame, labels: DataFrame, editions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Paragraphs with a stretch in a language that the label does not name, and tagged ones whose flags are mostly wrong."""
    held = stretches(rows, labels, editions).where(F.col("n_words") >= STRETCH).select("section_id", "par_n", "lang").distinct()
    named = labels.where("section_id is not null").groupBy("section_id").agg(F.array_distinct(F.flatten(F.collect_list(label_names(F.col("lang_label"))))).alias("named"))
    unnamed = held.join(named, "section_id", "left").where(~F.coalesce(F.array_contains("named", F.col("lang")), F.lit(False))).select("section_id", "par_n", "lang")
    flags = token_paragraphs(tokens).where("2 * n_wrong > n_tokens").select("section_id", "par_n", "lang")
    return unnamed.unionByName(flags)
