"""Sections as TEI: text, header, segmentation and morphosyntax, one document each."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

TEI, XML, XI, NKJP = "http://www.tei-c.org/ns/1.0", "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2001/XInclude", "http://www.nkjp.pl/ns/1.0"
ET.register_namespace("xi", XI)
ET.register_namespace("nkjp", NKJP)
_ID, _LANG = f"{{{XML}}}id", f"{{{XML}}}lang"


def _add(parent: ET.Element, tag: str, text: str | None = None, **attrs: str) -> ET.Element:
    out = ET.SubElement(parent, tag, attrs)
    out.text = text
    return out


def _shell(name: str | None = None, lang: str | None = None) -> tuple[ET.Element, ET.Element]:
    """An empty corpus and its body."""
    corpus = ET.Element("teiCorpus", {"xmlns": TEI})
    tei = ET.SubElement(corpus, "TEI")
    ET.SubElement(tei, f"{{{XI}}}include", {"href": "header.xml"})
    text = ET.SubElement(tei, "text", ({_ID: f"{name}_text"} if name else {}) | ({_LANG: lang} if lang else {}))
    return corpus, ET.SubElement(text, "body", {_ID: f"{name}_body"} if name else {})


def header(section: dict, config: dict, corpus: str, region: str | None, note_n: int = 1) -> ET.Element:
    """config: authors by "<document id>:::<title>", default_convent_author, page_num_shift, publication_info."""
    meta = section["section_type"] == "meta"
    out = ET.Element("teiHeader", {"xmlns": TEI, _ID: f"note_{note_n}" if meta else f"{corpus}-{section['document_id']}"})
    _add(_add(out, "titleStmt"), "title", f"TEI P5 encoded version of note {note_n}" if meta else f'TEI P5 encoded version of "{section["title"]}"')
    source = _add(out, "sourceDesc")
    original = _add(source, "bibl", type="original")
    if section.get("date"):
        _add(original, "date", str(section["date"]), when=str(section["date"]))
    _add(original, "region", region)
    _add(original, "author", author_of(section, config))
    if not meta:
        _add(original, "title", section["title"], level="a")
    if info := config.get("publication_info"):
        edition = _add(source, "bibl", type="edition")
        _add(edition, "title", section["book_title"], level="s")
        _add(edition, "editor", info["editor"])
        _add(edition, "pubPlace", info["place"], role="place")
        _add(edition, "date", str(info["year"]), when=str(info["year"]))
        first, last = (section["paragraphs"][k][0] + config.get("page_num_shift", 0) for k in (0, -1))
        _add(edition, "biblScope", str(first) if first == last else f"{first}-{last}", unit="page")
    _add(out, "revisionDesc")
    return out


def author_of(section: dict, config: dict) -> str | None:
    return config.get("authors", {}).get(f"{section['document_id']}:::{section['title']}") or config.get("default_convent_author")


def raw_text(section: dict, config: dict, page_before: int | None = None, note_n: int = 1) -> ET.Element:
    """Paragraphs (page, text), page breaks where the page changes and at the start."""
    corpus, body = _shell()
    if section["section_type"] == "meta":
        ET.SubElement(body, "note", {_ID: f"notebody_{note_n}", "type": "meta-text"}).text = section["paragraphs"][0][1]
        return corpus
    kind = "document-sejmik-resolution" if "sejmik" in (author_of(section, config) or "") else "document-sejmik-other"
    div = ET.SubElement(body, "div", {_ID: f"txt_{section['document_id']}-div", "type": kind})
    for n, (page, text) in enumerate(section["paragraphs"], 1):
        p = ET.SubElement(div, "p", {_ID: f"txt_1.{n}-ab"})
        if n == 1 or page != page_before:
            mark = ET.SubElement(p, "pb", {"n": str(page + config.get("page_num_shift", 0))} | ({"type": "doc_start"} if n == 1 else {}))
            mark.tail = text
        else:
            p.text = text
        page_before = page
    return corpus


class _Numbers:
    def __init__(self) -> None:
        self.n = 0

    def next(self) -> int:
        self.n += 1
        return self.n


def _segment(parent: ET.Element, numbers: _Numbers, token: dict, spaced: bool, of: str) -> None:
    seg = ET.SubElement(parent, "seg", {_ID: f"segm_1.{numbers.next()}-seg", "corresp": f"text.xml#string-range({of},{token['offset']},{len(token['orth'])})"})
    if not spaced:
        seg.set(f"{{{NKJP}}}nps", "true")
    _add(seg, "w", token["orth"])


def _end(token: dict) -> int:
    return token["offset"] + len(token["orth"])


def _spaced(position, last: int | None) -> bool:
    token = position if isinstance(position, dict) else position[0][0]
    return last is None or last != token["offset"]


def segmentation(paragraphs: Sequence[Sequence[Sequence]]) -> ET.Element:
    """Paragraphs of sentences of positions. A position is a token, or a list of alternatives, each a list of tokens.

    Segments point at the paragraph of the same number in the raw text.
    """
    corpus, body = _shell("segm", "pl")
    numbers, sent = _Numbers(), _Numbers()
    for n, par in enumerate(paragraphs, 1):
        p, last = ET.SubElement(body, "p", {_ID: f"segm_{n}-p"}), None
        for sentence in par:
            s = ET.SubElement(p, "s", {_ID: f"segm_{n}.{sent.next()}-s"})
            for position in sentence:
                spaced = _spaced(position, last)
                if isinstance(position, dict):
                    _segment(s, numbers, position, spaced, f"txt_1.{n}-ab")
                    last = _end(position)
                    continue
                choice = ET.SubElement(s, "choice")
                for option in position:
                    parent = ET.SubElement(choice, f"{{{NKJP}}}paren") if len(option) > 1 else choice
                    for k, token in enumerate(option):
                        _segment(parent, numbers, token, spaced if k == 0 else _end(option[k - 1]) != token["offset"], f"txt_1.{n}-ab")
                last = _end(position[-1][-1])
    return corpus


def _analysis(parent: ET.Element, n: int, token: dict, spaced: bool) -> None:
    """Interpretations that share base and class are one, with their forms as alternatives."""
    seg = ET.SubElement(parent, "seg", {_ID: f"morph_1.{n}-seg", "corresp": f"ann_segmentation.xml#segm_1.{n}-seg"})
    fs = _add(seg, "fs", type="morph")
    if not spaced:
        _add(_add(fs, "f", name="nps"), "binary", value="true")
    _add(_add(fs, "f", name="orth"), "string", token["orth"])
    interps = _add(fs, "f", name="interps")
    groups: list[tuple[tuple[str, str], list[str]]] = []
    for x in token["interps"]:
        if groups and groups[-1][0] == (x["base"], x["ctag"]):
            groups[-1][1].append(x["msd"])
        else:
            groups.append(((x["base"], x["ctag"]), [x["msd"]]))
    k = 0
    for (base, ctag), forms in groups:
        lex = _add(interps, "fs", type="lex")
        _add(_add(lex, "f", name="base"), "string", base)
        _add(_add(lex, "f", name="ctag"), "symbol", value=ctag)
        msd = _add(lex, "f", name="msd")
        place = ET.SubElement(msd, "vAlt") if len(forms) > 1 else msd
        for form in forms:
            k += 1
            ET.SubElement(place, "symbol", {_ID: f"morph_1.{n}.{k}.1-msd", "value": form})


def morphosyntax(paragraphs: Sequence[Sequence[Sequence]]) -> ET.Element:
    """As segmentation, with what each token is."""
    corpus, body = _shell("morph", "pl")
    numbers, sent = _Numbers(), _Numbers()
    for n, par in enumerate(paragraphs, 1):
        p, last = ET.SubElement(body, "p", {_ID: f"morph_{n}-p"}), None
        for sentence in par:
            s = ET.SubElement(p, "s", {_ID: f"morph_{n}.{sent.next()}-s"})
            for position in sentence:
                spaced = _spaced(position, last)
                options = [[position]] if isinstance(position, dict) else position
                for option in options:
                    for k, token in enumerate(option):
                        _analysis(s, numbers.next(), token, spaced if k == 0 else _end(option[k - 1]) != token["offset"])
                last = _end(options[-1][-1])
    return corpus


def _string(root: ET.Element) -> str:
    return ET.tostring(root, encoding="unicode")


def corpus_files(sections: DataFrame, config: dict, corpus: str) -> DataFrame:
    """(path, xml): text.xml and header.xml of each section, in a folder named by the header, and ann_segmentation.xml and ann_morphosyntax.xml where it is parsed.

    sections has book_title, section_n, section_type, document_id, title, date, convent_location, paragraphs
    (ARRAY<STRUCT<page, text>>) and, optionally, parsed: for each paragraph an array of sentences of tokens
    (orth, offset, interps of base, ctag, msd). Each section is written by itself; a sink saves the rows.
    """
    with_parse = "parsed" in sections.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, files = [], []
            for r in batch.to_pylist():
                section = r | {"paragraphs": [(p["page"], p["text"]) for p in r["paragraphs"] or []]}
                if not section["paragraphs"]:
                    continue
                n = int(r["section_n"]) + 1
                about = header(section, config, corpus, r["convent_location"], n)
                folder = f"{corpus.replace(' ', '_')}/{about.get(_ID)}"
                made = {"text.xml": raw_text(section, config, note_n=n), "header.xml": about}
                if with_parse and r["parsed"] is not None:
                    made |= {"ann_segmentation.xml": segmentation(r["parsed"]), "ann_morphosyntax.xml": morphosyntax(r["parsed"])}
                paths += [f"{folder}/{name}" for name in made]
                files += map(_string, made.values())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.string())], names=["path", "xml"])

    return sections.mapInArrow(run, "path string, xml string")
