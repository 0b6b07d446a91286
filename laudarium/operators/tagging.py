"""The boundary to taggers and spelling checkers: paragraphs in pieces, an engine started once for each task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MOST = 2500

#: From a piece of text to sentences, each a list of (form, lemma, tags).
Engine = Callable[[str], Iterable[list[tuple[str, str, list[str]]]]]


def pieces(text: str, most: int = MOST) -> list[str]:
    """Pieces of at most `most` characters, cut at the last blank; a longer run without blanks is cut through."""
    out = []
    while len(text) > most:
        at = text.rfind(" ", 1, most + 1)
        at = most if at <= 0 else at
        out.append(text[:at])
        text = text[at:].lstrip(" ")
    return [*out, text] if text else out


def tag(paragraphs: DataFrame, start: Callable[[], Engine], leave_hyphens: bool = True) -> DataFrame:
    """(section_id, par_n, sent_n, tok_n, form, lemma, interp) of (section_id, par_n, paragraph).

    start makes an engine; it runs once for each task, not for each paragraph. Null paragraphs give nothing.
    Without hyphens the hyphen at the end of a line goes with the line break.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = start()
        for batch in batches:
            rows = []
            for section, par, text in zip(batch["section_id"], batch["par_n"], batch["paragraph"]):
                sent = 0
                plain = (text or "") if leave_hyphens else (text or "").replace("-\n", "")
                for piece in pieces(plain):
                    for sentence in engine(piece):
                        rows += [(section, par, sent, k, form, lemma, list(tags)) for k, (form, lemma, tags) in enumerate(sentence)]
                        sent += 1
            yield pd.DataFrame(rows, columns=["section_id", "par_n", "sent_n", "tok_n", "form", "lemma", "interp"])

    return paragraphs.select("section_id", "par_n", "paragraph").mapInPandas(run, "section_id long, par_n int, sent_n int, tok_n int, form string, lemma string, interp array<string>")


def expand(lemmas: DataFrame, start: Callable[[], Callable[[str], Iterable[str]]]) -> DataFrame:
    """(lemma, form): each lemma with the distinct forms that an engine declines it to, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decline = start()
        for batch in batches:
            yield pd.DataFrame([(w, f) for w in batch["lemma"] if w is not None for f in dict.fromkeys(decline(w))], columns=["lemma", "form"])

    return lemmas.select("lemma").distinct().mapInPandas(run, "lemma string, form string")


def transfer_spaces(parsed: DataFrame) -> DataFrame:
    """(…, pause, offset) for rows (section_id, par_n, raw, forms): where each form stands in the raw paragraph, and the blanks before it.

    Forms are looked for one after the other from the place of the last; one that is not there has place -1 and no pause.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for section, par, raw, forms in zip(batch["section_id"], batch["par_n"], batch["raw"], batch["forms"]):
                at, end = 0, 0
                for k, form in enumerate(forms if forms is not None else []):
                    place = (raw or "").find(form, at)
                    pause = raw[end:place] if place >= end else ""
                    rows.append((section, par, k, form, place, pause if not pause.strip() else ""))
                    if place >= 0:
                        at, end = place, place + len(form)
            yield pd.DataFrame(rows, columns=["section_id", "par_n", "tok_n", "form", "offset", "pause"])

    return parsed.select("section_id", "par_n", "raw", "forms").mapInPandas(run, "section_id long, par_n int, tok_n int, form string, offset int, pause string")
