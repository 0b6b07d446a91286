"""Manual decisions over loaded sections: titles, dates, types, pertinence, splits and merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import match_key
from ..functions.dates import to_date
from .loader import numbered

CONTEXT = 80  # characters of a paragraph's begin or end that a decision names

PARAGRAPH = "edition string, section_n int, section_type string, page_n int, par_n int, text string"


def _last(decisions: DataFrame, kind: str, *values: str) -> DataFrame:
    """Decisions of a kind as (page, title key, number, values)."""
    return decisions.where(F.col("decision_type") == kind).select(F.col("pagenum"), match_key(F.col("from_title")).alias("title_key"), "decision_n", *values)


def apply_decisions(sections: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sections (edition, section_n, title, start_page, end_page, section_type, date, pertinence) with later decisions applied, and numbered anew.

    A decision meets a section if its page is one of the section's and its title is the section's, white space
    aside: an equi-join on the title, then the range of pages. Of several the last in the file holds. After a
    new title, dates and pertinence that name the old one still apply.
    """
    keyed = sections.withColumn("title_key", match_key(F.col("title")))
    met = lambda d: keyed.select("edition", "section_n", "title_key", "start_page", "end_page").join(d, "title_key").where("pagenum between start_page and end_page")
    pick = lambda d, value, name: met(d).groupBy("edition", "section_n").agg(F.max_by(value, "decision_n").alias(name))
    titles = pick(_last(decisions, "title_form", "to_title"), "to_title", "_title")
    dates = pick(_last(decisions, "date", "date"), "date", "_date")
    types = pick(_last(decisions, "type", F.col("section_type").alias("_to")), "_to", "_type")
    pertinence = pick(_last(decisions, "pertinence", "pertinence_status"), "pertinence_status", "_pert")
    out = keyed
    for d in (titles, dates, types, pertinence):
        out = out.join(d, ["edition", "section_n"], "left")
    out = out.withColumns({
        "title": F.coalesce("_title", "title"), "section_type": F.coalesce("_type", "section_type"), "pertinence": F.coalesce("_pert", "pertinence"),
        "date": F.coalesce(to_date(F.col("_date.day"), F.col("_date.month"), F.col("_date.year")), "date"),
    })
    return numbered(out.drop("_title", "_date", "_type", "_pert", "title_key", "inbook_section_id", "inbook_document_id"))


def _key(text: str) -> str:
    return "".join(text.replace("\\n", "").split())


def _replayed(sections: pd.DataFrame, decisions: pd.DataFrame) -> pd.DataFrame:
    """One edition: splits in order of paragraphs, then merges in order of sections."""
    by_page: dict[int, list] = {}
    for d in decisions.sort_values("decision_n").itertuples(index=False):
        by_page.setdefault(d.pagenum, []).append(d)
    listed: list[tuple[str, list[tuple[int, str]]]] = []
    for _, own in sections.sort_values(["section_n", "page_n", "par_n"]).groupby("section_n"):
        kind, notes, docs = own["section_type"].iat[0], [], [[]]
        for k, (page, text) in enumerate(zip(own["page_n"], own["text"])):
            split = next((d for d in by_page.get(page, []) if d.decision_type == "split_sections" and _key(d.following_fragm or "") == _key(text[:CONTEXT])), None)
            if k and split is not None and split.new_section_type == "document":
                docs.append([(page, text)])
            elif k and split is not None and split.new_section_type == "meta":
                notes.append([(page, text)])
            elif k and split is not None:
                raise ValueError(f"a split into {split.new_section_type}")
            else:
                docs[-1].append((page, text))
        listed += [(kind, docs[0]), *[("document", d) for d in docs[1:]], *[("meta", n) for n in notes]]
    out: list[tuple[str, list[tuple[int, str]]]] = []
    for kind, pars in listed:
        page, title = pars[0]
        merge = next((d for d in by_page.get(page, []) if d.decision_type == "merge_sections" and _key(d.from_title or "") == _key(title) and _key(d.following_fragm or "") == _key(title[:CONTEXT])), None)
        if merge is None:
            out.append((kind, pars))
            continue
        for target in reversed([s for s in out if s[0] == "document"]):
            places = [k for k, (_, text) in enumerate(target[1]) if _key(text[-CONTEXT:]) == _key(merge.preceding_fragm or "")]
            if len(places) > 1:
                raise ValueError("ambiguous merge: several paragraphs end as named")
            if places:
                target[1][places[0] + 1 : places[0] + 1] = pars
                break
        else:
            raise ValueError("a merge decision meets no earlier document")
    edition = sections["edition"].iat[0]
    rows = [(edition, n, kind, page, k, text) for n, (kind, pars) in enumerate(out) for k, (page, text) in enumerate(pars, 1)]
    return pd.DataFrame(rows, columns=["edition", "section_n", "section_type", "page_n", "par_n", "text"])


def replay(sections: DataFrame, decisions: DataFrame) -> DataFrame:
    """Splits and merges replayed over paragraphs (edition, section_n, section_type, page_n, par_n, text), an edition at a time.

    The order of sections decides what a merge meets, so an edition that has decisions, a printed book, is one group;
    others stay as they are, with their numbers. A split
    into a document takes the rest of its section, one into a note a single paragraph. A merge goes after the
    paragraph of the nearest earlier document that ends as named; none, or several, are errors.
    """
    plain = decisions.where("decision_type in ('split_sections', 'merge_sections')").select("decision_n", "decision_type", "pagenum", "from_title", "preceding_fragm", "following_fragm", "new_section_type")
    known = plain.join(sections.select("edition", F.col("page_n").alias("pagenum")).distinct(), "pagenum") if "edition" not in decisions.columns else plain.join(decisions.select("decision_n", "edition"), "decision_n")
    known = known.withColumnRenamed("edition", "of")
    own = sections.select("edition", "section_n", "section_type", "page_n", "par_n", "text")
    decided = known.select(F.col("of").alias("edition")).distinct()
    touched = own.join(decided, "edition", "left_semi")
    replayed = touched.groupBy("edition").cogroup(known.groupBy("of")).applyInPandas(lambda s, d: _replayed(s, d) if len(s) else s, PARAGRAPH)
    return replayed.unionByName(own.join(decided, "edition", "left_anti"))
