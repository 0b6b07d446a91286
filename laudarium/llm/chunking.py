"""Long sections cut into overlapping pieces: rolling-hash landmarks snap to the nearest natural boundary."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

MOST, LEAST, OVERLAP = 2500, 1200, 200
#: One landmark in about so many characters.
LANDMARK_EVERY = 256
#: A paragraph in so many, by a hash of its text, ends a group; groups are cut by themselves, so their ends are cuts that no edit elsewhere moves.
GROUP_PARAGRAPHS = 256
#: Where no paragraph is such an end (all may be alike), so many places after the last one a group ends all the same.
LONGEST_GROUP = 4 * GROUP_PARAGRAPHS
#: Places of a section that one task looks through for ends of groups.
PLACES = 4096
JOIN = "\n\n"
#: Kinds of cut; NATURAL has those at a boundary of the text, from the most natural.
PARAGRAPH, SENTENCE, BLANK, NONE, CLAUSE = 0, 1, 2, 3, 4
KINDS = ("paragraph", "sentence", "blank", "none", "clause")
NATURAL = (PARAGRAPH, SENTENCE, CLAUSE, BLANK)

_BLANKS = re.compile(r"\s+")
_HAN, _CLOSING = r"[\u3400-\u9fff]", r"[”’»」』）》〉】)\]]*+"
#: Blanks, and the marks that end a sentence or a clause without one; a sentence goes on where a clause mark follows its end.
_PAUSES = re.compile(
    rf"(?P<blank>\s+)|(?P<sentence>(?:[。！？։]|(?<={_HAN})[.!?](?={_HAN}))++{_CLOSING}(?![\s，；：、]))"
    rf"|(?:[，；：、]|(?<={_HAN})[,;:](?={_HAN}))++{_CLOSING}(?!\s)"
)
_STOP = re.compile(r"[.!?…։。！？][\"'”’»“」』)\]]*\s*$")
_HELD = re.compile(r"[,;:，；：、][\"'”’»“」』)\]]*\s*$")
_HASH_STEPS = 5  # a window of 2 ** 5 characters


def landmarks(text: str) -> np.ndarray:
    """Places where a rolling hash of the last 32 characters meets the mask: the same wherever the same words stand."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for k in range(_HASH_STEPS):  # the hash of 2 ** k characters to that of twice as many
        shifted = np.zeros_like(h)
        shifted[1 << k :] = h[: -(1 << k)] if len(h) > 1 << k else 0
        h = h + shifted * np.uint64(pow(0x100000001B3, 1 << k, 1 << 64))
    h ^= h >> np.uint64(32)
    return np.flatnonzero(h % np.uint64(LANDMARK_EVERY) == 0) + 1


class _Bounds:
    """Allowed cuts of a text by kind: where a piece may end, and where the next one then begins, behind the blanks.

    A paragraph that fits a piece is never cut; one that does not is cut after sentences and clauses, also where no blank follows
    them, and at blanks.
    """

    def __init__(self, paragraphs: list[str], most: int) -> None:
        self.text = JOIN.join(paragraphs)
        self.ends: dict[int, list[int]] = {k: [] for k in NATURAL}
        self.next: dict[int, int] = {}
        at = 0
        for p in paragraphs:
            if len(p) > most:
                for m in _PAUSES.finditer(p):
                    if not m["blank"]:
                        if m.end() < len(p):
                            self.ends[SENTENCE if m["sentence"] else CLAUSE].append(at + m.end())
                    elif m.start():
                        near = max(0, m.start() - 6), m.start()
                        self.ends[SENTENCE if _STOP.search(p, *near) else CLAUSE if _HELD.search(p, *near) else BLANK].append(at + m.start())
                        self.next[at + m.start()] = at + m.end()
            self.ends[PARAGRAPH].append(at + len(p))
            self.next[at + len(p)] = min(at + len(p) + len(JOIN), len(self.text))
            at += len(p) + len(JOIN)

    def best(self, kind: int, start: int, least: int, easy: int, most: int, want: int) -> int | None:
        """The end of a kind nearest to want in [least, easy], else the last before it, else the first up to most."""
        at = self.ends[kind]
        i, j, k = bisect.bisect_left(at, least), bisect.bisect_right(at, easy), bisect.bisect_right(at, start)
        if i < j:
            near = bisect.bisect_left(at, want, i, j)
            return min(at[max(i, near - 1) : min(j, near + 1)], key=lambda x: (abs(x - want), x))
        if k < min(i, j):
            return at[min(i, j) - 1]
        return at[j] if j < len(at) and start < at[j] <= most else None


def _word_start(text: str, low: int, high: int) -> int:
    """The first start of a word in [low, high); low if that stands in a longer run; high if nothing is left."""
    if low >= high or low == 0 or text[low - 1].isspace():
        return min(low, high)
    m = _BLANKS.search(text, low, high)
    return m.end() if m else low


def cut(paragraphs: list[str], before: str = "", most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces (begin, start, end, kind) of a group of paragraphs: text[begin:end], new from start on, and the kind of its end.

    From a piece's start, the first landmark at least `least` away is the wish, and the natural boundary
    nearest to it is the cut: between paragraphs if one can be reached, else after a sentence, else after a
    clause, else at a blank, else, in a run without any of them, the landmark itself. The overlap shrinks where otherwise a
    paragraph or a word would not fit as a whole. Blanks at a cut lie between the pieces. before is what
    precedes the group; places in it are negative.
    """
    lead = before[-overlap - len(JOIN):] if before else ""
    bounds = _Bounds(paragraphs, most)
    whole, shift, n = lead + bounds.text, len(lead), len(bounds.text)
    marks = landmarks(bounds.text)
    ended, floor = (-len(JOIN) if lead else 0), -shift
    pieces, start = [], 0
    while start < n:
        if bounds.next.get(start, start) > start:  # an empty paragraph
            start = bounds.next[start]
            continue
        begin = _word_start(whole, max(floor, ended - overlap) + shift, ended + shift) - shift
        begin = start if begin >= ended else begin
        if n - begin <= most:
            end, kind = n, PARAGRAPH
        else:
            k = int(np.searchsorted(marks, start + least))
            easy = begin + most
            want = min(int(marks[k]) if k < len(marks) else easy, easy)
            for kind in NATURAL:
                if (end := bounds.best(kind, start, start + least, easy, start + most, want)) is not None:
                    break
            else:
                end, kind = max(want, start + 1), NONE
        if end - begin > most:
            begin = _word_start(whole, end - most + shift, ended + shift) - shift
            begin = start if begin >= ended else begin
        pieces.append((begin, start, end, kind))
        floor, ended, start = begin, end, bounds.next.get(end, end)
    return pieces


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for section, group, paragraphs, before in zip(batch["section_id"], batch["group_n"], batch["paragraphs"], batch["before"]):
            paragraphs = list(paragraphs)
            whole, shift = (before or "") + JOIN.join(paragraphs), len(before or "")
            unbroken = any(len(w) > MOST for p in paragraphs if len(p) > MOST for w in p.split())
            for k, (begin, start, end, kind) in enumerate(cut(paragraphs, before or "")):
                rows.append((section, group, k, whole[begin + shift : end + shift], start - begin, start, end, kind, unbroken))
        yield pd.DataFrame(rows, columns=["section_id", "group_n", "k", "piece", "overlap", "start", "end", "kind", "unbroken"])


def pieces(rows: DataFrame) -> DataFrame:
    """(section_id, piece_n, piece, overlap, char_start, char_end, cut_kind) of the sections of more than MOST characters.

    A section is its paragraphs as stored, in order of par_n, joined by two line breaks. Pieces are numbered
    from 1; piece holds the overlap first, whose length with the blanks after it is given; char_start and
    char_end are the places of what is new. cut_kind is the kind of cut of the piece's end: paragraph,
    sentence, clause, blank or none (within a run of letters).

    Paragraphs are cut in groups, so a section of any length is many tasks' work. A group ends at a paragraph
    whose own hash says so, about every GROUP_PARAGRAPHS, so that a paragraph more or less leaves all other
    groups as they are; the overlap goes on over their ends. Copies count once. Null paragraphs are left out;
    so are rows without a section. Rows without par_n come first, in the order of a hash. Short sections give no rows.
    """
    return _placed(rows).drop("unbroken")


def _grouped(text: DataFrame) -> DataFrame:
    """(section_id, group_n, paragraphs) of (section_id, place, paragraph): the paragraphs of a group in order, group_n the place of the first.

    Ends are carried on over blocks of PLACES first and within a block then.
    """
    keys = ["section_id", "block"]
    ends = F.pmod(F.xxhash64("paragraph"), F.lit(GROUP_PARAGRAPHS)) == 0
    marked = text.withColumn("block", F.floor(F.col("place") / PLACES)).withColumn("end", F.when(ends, F.col("place")))
    before = Window.unboundedPreceding, -1
    of_blocks = marked.groupBy(*keys).agg(F.max("end").alias("end"))
    carried = of_blocks.select(*keys, F.max("end").over(Window.partitionBy("section_id").orderBy("block").rowsBetween(*before)).alias("carried"))
    within = F.max("end").over(Window.partitionBy(*keys).orderBy("place", "paragraph").rowsBetween(*before))
    start = F.coalesce("within", "carried", F.lit(-(1 << 62) - 1)) + 1
    far = F.when(F.col("place") < 0, 0).otherwise(F.floor((F.col("place") - F.greatest("start", F.lit(0))) / LONGEST_GROUP))  # places that are hashes lie far apart
    placed = marked.withColumn("within", within).join(carried, keys).withColumn("start", start).withColumn("far", far)
    return placed.groupBy("section_id", "start", "far").agg(
        F.min("place").alias("group_n"), F.sort_array(F.collect_list(F.struct("place", "paragraph"))).getField("paragraph").alias("paragraphs")
    ).drop("start", "far")


def _placed(rows: DataFrame) -> DataFrame:
    """pieces, with unbroken: their group of paragraphs holds a run of more than MOST characters without white space."""
    place = F.coalesce(F.col("par_n").cast("long"), -F.xxhash64("paragraph").bitwiseAND((1 << 62) - 1) - 1)
    text = rows.where("section_id is not null and paragraph is not null").select("section_id", place.alias("place"), "paragraph").distinct()
    long = text.groupBy("section_id").agg((F.sum(F.length("paragraph")) + (F.count("*") - 1) * len(JOIN)).alias("size")).where(F.col("size") > MOST)
    grouped = written(_grouped(text.join(long, "section_id", "left_semi")), "groups")
    text_of = F.array_join("paragraphs", JOIN)
    order = Window.partitionBy("section_id").orderBy("group_n")
    slim = grouped.select("section_id", "group_n", F.right(F.concat(text_of, F.lit(JOIN)), F.lit(OVERLAP + len(JOIN))).alias("tail"), (F.length(text_of) + len(JOIN)).alias("size"))
    before = slim.select(
        "section_id", "group_n", F.lag("tail").over(order).alias("before"),
        F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    cuts = grouped.join(before.select("section_id", "group_n", "before"), ["section_id", "group_n"]).mapInPandas(
        _pieces, "section_id long, group_n long, k int, piece string, overlap int, start long, end long, kind int, unbroken boolean"
    )
    earlier = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = cuts.groupBy("section_id", "group_n").agg(F.count("*").alias("n")).select("section_id", "group_n", earlier.alias("earlier"))
    return (
        cuts.join(before.select("section_id", "group_n", "offset"), ["section_id", "group_n"])
        .join(numbers, ["section_id", "group_n"])
        .select(
            "section_id", (F.col("earlier") + F.col("k") + 1).alias("piece_n"), "piece", "overlap",
            (F.col("offset") + F.col("start")).alias("char_start"), (F.col("offset") + F.col("end")).alias("char_end"),
            F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("cut_kind"), "unbroken",
        )
    )


def found(rows: DataFrame) -> DataFrame:
    """The long sections, each with the level down to which its paragraphs leave white space to cut it at: unbroken, whatever marks such a run holds."""
    worst = F.when(F.max("unbroken"), "unbroken").when(F.max(F.col("cut_kind") != "paragraph"), "within").otherwise("paragraph")
    return _placed(rows).groupBy("section_id").agg(worst.alias("cut_level"))
