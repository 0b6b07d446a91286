"""Sentences by cascading segmentation rules: break and no-break pairs, the first that matches decides a place."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAK, KEEP = True, False
Rule = tuple[bool, str, str]

# Opening quotation marks and the marks that may close them.
QUOTES = {"„": "”“", "“": "”", "«": "»", "»": "«", '"': '"', "「": "」", "『": "』", "‘": "’", "《": "》"}
STOPS = ".!?…։。！？"


def _short(words: str) -> str:
    """Before a place: one of these words as a whole, with its point."""
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(w.replace(" ", r"\s*") for w in words.split("|")) + r")\.$"


#: Rule tables: (break?, what stands before the place, what stands after it). Abbreviations are as they are printed.
TABLES: dict[str, list[Rule]] = {
    "speech": [
        (KEEP, r"[.!?…։。！？]\s?[»«”“\"」』’]$", r"\s*[,，;；:：]|\s*[—–-]?\s*\p{Ll}"),
        (BREAK, r"[.!?…։。！？]\s?[»«”“\"」』’]$", r"\s*\S"),
    ],
    "zh": [(BREAK, r"[。！？]$", r"\s*\S"), (BREAK, r"\p{Han}[.!?…]+$", r"\s*\p{Han}")],
    "hy": [(BREAK, r"։$", r"\s*\S"), (KEEP, _short("պրն|Պրն|թ|հ|օր|այլ"), r"\s*\S")],
    "numbers": [
        (KEEP, r"\p{N}\.$", r"\p{N}"),
        (KEEP, r"§\s*\p{N}+\.$", r"\s*\S"),
        (KEEP, r"[.…]$", r"\s*[,;:)\]]|[-‐–]"),
    ],
    "lower": [(KEEP, r"[.!?…]$", r"\s*[—–-]?\s*\p{Ll}")],
    "ends": [
        (BREAK, _short("itd|itp|etc|usw|u\\. s\\. w|т\\. д|т\\. п|і т\\. д|і т\\. ін"), r"\s+\S|\p{Lu}"),
        (BREAK, r"\p{N}{3,4}\s+[rр]\.$", r"\s+\S|\p{Lu}"),
        (BREAK, r"(?:\bwyż\.\s*wsp|\bp\.\s*ex|\bv\.\s*fol|\bA\.\s*D)\.$", r"\s*\p{Lu}"),  # as above, for example, see the folio: they end what refers back
        (BREAK, r"(?:fol|f|арк|k)\.\s+\p{N}+\s+[vr]\.$", r"\s+\S|\p{Lu}"),
        (BREAK, r"(?:rozdz|art|Art|chap|cap|t|ks)\.\s+[IVXLC]+\.$", r"\s+\S|\p{Lu}"),
    ],
    "de": [
        (KEEP, r"(?<!\p{N})\p{N}{1,2}\.$", r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Jh|Tag)"),
        (KEEP, _short("Nr|lt|Art|bzw|St|Hr|Hrn|Dr|Se|Exz|Fr|Frh|Prof|d\\. h|z\\. B|v|vgl|Abs|Bd|ca|geb|gest|hl|S|u\\. a"), r"\s*\S"),
    ],
    "fr": [(KEEP, _short("M|MM|Mgr|Mme|Mlle|St|Ste|S\\. E|chap|art|av|apr|cf|fol|p|p\\. ex|vol|ch|env"), r"\s*\S")],
    "la": [(KEEP, _short("fol|f|art|cap|lib|cf|v|D|Dns|dns|R\\. P|S|S\\. R\\. M|Rev|Ill|Magn|Gen|sc|i\\. e|N"), r"\s*\S")],
    "pl": [
        (
            KEEP,
            _short("np|tj|tzn|tzw|św|śś|ks|Ks|arcyb|Arcyb|bp|abp|p|pp|P|Imć P|JMP|JMć|JW|WP|fol|art|rozdz|pow|woj|ziem|gm|godz|gr|zł|złp|lit|sygn|nr|Nr|m|t|wyż|wsp|ww|cf|zob|por|str|s|r|w|im|ur|zm|dr|prof|red|jw|tegoż|dn|sp"),
            r"\s*\S",
        ),
    ],
    "uk": [(KEEP, _short("с|м|р|рр|св|арк|п|пп|о|оо|т|ст|ч|гл|див|напр|ім|вид|грн|зол"), r"\s*\S")],
    "initials": [(KEEP, r"(?<!\p{L})\p{Lu}\.$", r"\s*\S")],
    "default": [(BREAK, r"[.!?…]$", r"\s*\S"), (BREAK, r"[.!?…][)\]]+$", r"\s+\S")],
}
#: Languages with a table of their own, asked after what holds for all. Where the language is not known, all are, one after the other.
LANGUAGES = ("de", "fr", "la", "pl", "uk")
Spans = Callable[[str], list[tuple[int, int, str]]]


@lru_cache(16)
def _cascade(languages: tuple[str, ...]) -> list[tuple[bool, regex.Pattern, regex.Pattern]]:
    names = ["speech", "zh", "hy", "numbers", "lower", "ends", *languages, "initials", "default"]
    return [(yes, regex.compile(before), regex.compile(after)) for name in names for yes, before, after in TABLES[name]]


_PLACE = regex.compile(r"[.!?…։。！？]+[)\]]*")
_BLANKS = regex.compile(r"\s*")
#: Characters before a place that rules look at: more than any abbreviation, number or reference in the tables has.
REACH = 48


def _speeches(text: str) -> list[tuple[int, int]]:
    """(place of the opening mark, place behind the closing one); a mark that is never closed opens nothing."""
    out, at = [], 0
    for m in regex.finditer("[" + "".join(QUOTES) + "]", text):
        if m.start() < at:
            continue
        close = min((k for c in QUOTES[m.group()] if (k := text.find(c, m.end())) >= 0), default=-1)
        if close >= 0:
            at = close + 1
            out.append((m.start(), at))
    return out


def sentence_starts(text: str | None, languages: Sequence[str] = LANGUAGES, title: bool = False, spans: Sequence[tuple[int, int, str]] = ()) -> list[int]:
    """Places of the first characters of the sentences; none in a null or blank text. A title is one sentence.

    spans are (start, end, language) in order: a place within one is decided by the table of that language alone,
    any other by those of `languages`.
    """
    if text is None or not text.strip():
        return []
    starts = [len(text) - len(text.lstrip())]
    if title:
        return starts
    rules, given, own = _cascade(tuple(languages)), iter(spans), None
    speeches = _speeches(text)
    places = [b for a, b in speeches if text[a + 1 : b - 1].rstrip()[-1:] in tuple(STOPS)]
    k = 0
    for m in _PLACE.finditer(text):
        while k < len(speeches) and speeches[k][1] <= m.start():
            k += 1
        if k == len(speeches) or speeches[k][0] > m.start():
            places.append(m.end())
    for place in sorted(set(places)):
        while spans and (own is None or own[1] < place) and (further := next(given, None)):
            own = further
        known = own is not None and own[0] < place <= own[1]
        before = text[max(0, place - REACH) : place]
        for yes, b, a in _cascade((own[2],) if own[2] in LANGUAGES else ()) if known else rules:
            if a.match(text, place) and b.search(before):
                if yes:
                    starts.append(_BLANKS.match(text, place).end())
                break
    return starts


def _rows(languages: Sequence[str], spans: Spans | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for section, par, text, title in zip(batch["section_id"], batch["par_n"], batch["paragraph"], batch["title"]):
                own = spans(text) if spans and not title and _PLACE.search(text) else ()
                starts = sentence_starts(text, languages, bool(title), own)
                for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(text or "")]), 1):
                    rows.append((section, par, n, a, text[a:b].rstrip()))
            yield pd.DataFrame(rows, columns=["section_id", "par_n", "sent_n", "sent_start", "sentence"]).astype({"section_id": "Int64", "par_n": "Int32"})

    return run


def sentences(rows: DataFrame, languages: Sequence[str] = LANGUAGES, spans: Spans | None = None) -> DataFrame:
    """(section_id, par_n, sent_n, sent_start, sentence) of every paragraph, scanned or not.

    spans gives the stretches of one language of a text (as langid.spans does): each is cut by the table of its
    language. Without it all tables hold for all texts. sent_start counts code points from 0. Speech stays in
    the sentence that quotes it. The first paragraph of a document is its title, one sentence. Copies count
    once; null, empty and blank paragraphs have no sentences. Paragraphs are single rows, so nothing is
    gathered, however long a section is.
    """
    title = (F.col("par_n") == 1) & (F.coalesce("section_type", F.lit("")) == "document")
    one = rows.where("paragraph is not null").select("section_id", "par_n", "paragraph", F.coalesce(title, F.lit(False)).alias("title")).distinct()
    return one.mapInPandas(_rows(tuple(languages), spans), "section_id long, par_n int, sent_n int, sent_start int, sentence string")


def found(rows: DataFrame, spans: Spans | None = None) -> DataFrame:
    return sentences(rows.where("scan_page = -1"), spans=spans).select("section_id", "par_n", "sent_start").distinct()
