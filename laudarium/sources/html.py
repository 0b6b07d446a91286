"""Editions published as HTML, in four known structures, to sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import heading_score, meta_reason

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
STRUCTURES = ("nowogr", "generic_doc", "chelmskie_doc", "wlkp_pdf")


@dataclass
class Node:
    """A child of the body: an element with what it holds, or text (tag is null)."""

    tag: str | None
    attrs: dict[str, str | None] = field(default_factory=dict)
    text: str = ""
    inner: dict[str, list[str]] = field(default_factory=dict)  # texts of the elements within, by tag
    langs: set[str] = field(default_factory=set)


class _Body(HTMLParser):
    """Children of the body (or of its first div), in order; scripts and styles give no text."""

    def __init__(self, in_div: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.in_div, self.nodes, self.depth, self.open, self.ready = in_div, [], 0, [], False
        self.has_body = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.ready:
            if tag == "body":
                self.has_body = True
            self.ready = tag == ("div" if self.in_div else "body")
            return
        if not self.open:
            self.nodes.append(Node(tag, dict(attrs)))
        else:
            self.nodes[-1].inner.setdefault(tag, []).append("")
            self.nodes[-1].langs |= {v for k, v in attrs if k == "lang" and v}
        if tag not in _VOID:
            self.open.append((tag, len(self.nodes[-1].inner.get(tag, ())) - 1 if self.open else None))

    def handle_endtag(self, tag: str) -> None:
        if not self.ready or tag in _VOID:
            return
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]
        elif tag in ("body", "div"):
            self.ready = False

    def handle_data(self, data: str) -> None:
        if not self.ready or any(t in ("script", "style") for t, _ in self.open):
            return
        if not self.open:
            self.nodes.append(Node(None, {}, data))
            return
        self.nodes[-1].text += data
        for tag, k in self.open[1:]:
            if k is not None and k >= 0:
                self.nodes[-1].inner[tag][k] += data


def nodes(html: str, in_div: bool = False) -> list[Node]:
    parser = _Body(in_div)
    parser.feed(html if in_div or re.search(r"<body\b", html, re.I) else f"<body>{html}</body>")
    parser.close()
    return parser.nodes


def _rows(structure: str, in_div: bool, strip_ruthenian: bool):
    """Each node as (pos, role, text). Roles that depend on scores of the text are left to Spark: see sections()."""

    def role(node: Node, page: int, before: Node | None) -> str:
        has = lambda t: len(node.inner.get(t, ()))
        text = node.text.strip()
        if structure == "wlkp_pdf":
            if node.tag is None:
                return "note" if page % 2 == 1 and before is not None and before.tag == "a" else "text" if text else "none"
            return "none" if node.tag != "i" else "heading" if re.match(r"\d+\.", text) else "note"
        if node.tag is None:
            return "none"
        if structure == "nowogr":
            if strip_ruthenian and "ru-RU" in node.langs:
                return "none"
            return "heading" if node.tag == "ol" and has("li") == 1 else "note" if has("b") else "text or note" if node.tag == "p" else "none"
        contents = "Wstęp" in text or text.count(".") > 10
        if structure == "generic_doc":
            if node.tag != "p":
                return "none"
            return "note" if has("b") else ("note" if contents or not re.search(r"\d", text) else "heading") if has("i") else "text if open"
        if node.tag not in ("p", "ol"):
            return "none"
        if has("font"):
            return "note"
        alone = any(has(t) == 1 and node.inner[t][0].strip() == text for t in ("b", "i"))
        if (node.attrs.get("align") == "center" or node.tag == "ol") and alone:
            return "note" if contents else "heading if scored"
        return "text if open"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for edition, html in zip(batch["edition"], batch["html"]):
                page, before = 0, None
                for pos, node in enumerate(nodes(html or "", in_div)):
                    page += node.tag == "hr"
                    out.append((edition, pos, role(node, page, before), node.text.strip()))
                    before = node
            yield pd.DataFrame(out, columns=["edition", "pos", "role", "text"])

    return run


def sections(pages: DataFrame, structure: str, in_div: bool = False, strip_ruthenian: bool = False, max_line: int = 200, max_heading: int = 300) -> DataFrame:
    """(edition, section_n, section_type, par_n, text) from files (edition, html) of one structure.

    Documents begin at headings; notes are sections of one paragraph and come where they stand, documents
    where the next heading commits them (the last one, which none follows, at the end). A null file gives nothing.
    """
    if structure not in STRUCTURES:
        raise ValueError(f"{structure} is not a known structure")
    from pyspark.sql import Window

    raw = pages.select("edition", "html").mapInPandas(_rows(structure, in_div, strip_ruthenian), "edition string, pos int, role string, text string").where("role <> 'none'")
    noted = meta_reason(F.col("text"), max_line).isNotNull()
    scored = raw.withColumn("role", F.when(F.col("role") == "text or note", F.when(noted, "note").otherwise("text")).when(F.col("role") == "heading if scored", F.when(heading_score(F.col("text"), max_heading) < 0.6, "note").otherwise("heading")).otherwise(F.col("role")))
    by = Window.partitionBy("edition").orderBy("pos")
    opened = F.sum((F.col("role") == "heading").cast("int")).over(by)
    placed = scored.withColumn("doc", opened).withColumn("role", F.when(F.col("role") == "text if open", F.when(F.col("doc") > 0, "text").otherwise("note")).otherwise(F.col("role")))
    ends = placed.where("role = 'heading'").groupBy("edition", (F.col("doc") - 1).alias("doc")).agg(F.min("pos").alias("commit"))
    docs = placed.where("role in ('heading', 'text')").join(ends, ["edition", "doc"], "left").withColumn("at", F.coalesce("commit", F.lit(2**31 - 1)))
    kind = docs.select("edition", "at", F.lit("document").alias("section_type"), "pos", "text").unionByName(placed.where("role = 'note'").select("edition", F.col("pos").alias("at"), F.lit("meta").alias("section_type"), "pos", "text"))
    order = Window.partitionBy("edition").orderBy("at", "section_type")
    return kind.withColumn("section_n", F.dense_rank().over(order) - 1).withColumn("par_n", F.row_number().over(Window.partitionBy("edition", "at", "section_type").orderBy("pos"))).select("edition", "section_n", "section_type", "par_n", "text")
