"""Text of scanned pages: headers and page numbers taken out, broken words joined, misread characters repaired."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..numbering import carry
from ..session import written

# What a scanner reads, and what was printed; a pair costs CONFUSED in the edit distance. What else is confused is learnt from the words.
CONFUSIONS = {
    "c": "eć", "e": "cęé", "5": "s", "0": "oо", "f": "te", "1": "liı", "q": "g", "t": "łf", "н": "ип", "n": "вu", "u": "n", "и": "п", "3": "зz", "ç": "ę", "6": "бó", "m": "ш",
    "ć": "é", "λ": "a", "8": "b", "l": "ł1i", "i": "l", "o": "ó0", "a": "ą", "z": "żź", "s": "ś5", "б": "6", "h": "b", "b": "h", "ь": "ъ", "ш": "щ",
    "!": "il", "«": "a", "|": "l", "z:": "ż", "s'": "ś", "c'": "ć", "n'": "ń", "z'": "źż", "o'": "ó",
    "ii": "nuü", "li": "h", "lj": "b", "cl": "d", "vv": "w", "rn": "m", "iii": "m", "ij": "y", "lc": "k",
}
CONFUSED = 0.25
#: Any other edit of one character.
OTHER = 1.0
#: At most so much edit distance between a misread word and its repair: two listed confusions, or one that was learnt.
MOST = 0.5
#: A pair of letters is learnt as a confusion if so many misread words show it, and so many times as often as words that are all known differ by it.
SHOWN, LIFT = 5, 8.0
#: A run of more letters is no word, and is not repaired.
LONGEST = 64
#: Rows of a section that one task looks through for the next one.
ROWS = 4096
#: A word that no unscanned text holds is misread if a word near to it is so many times as frequent.
TIMES = 3
#: Words of fewer letters are not repaired.
SHORTEST = 2
HYPHENS = "-­‐‑–¬="

#: A word as a scanner leaves it: some marks stand for letters within a word, or at its ends.
_WORD = r"(?:(?<!\S)[!«](?=\p{Ll}))?[\p{L}\p{N}\p{M}]+(?:['’!«:|](?=\p{L})[\p{L}\p{N}\p{M}]+)*(?:'(?=\s+\p{Ll})|[!«](?=[\s.,;:]|$))?"
_WORDS = regex.compile(_WORD)
_BROKEN = regex.compile(rf"({_WORD})[{regex.escape(HYPHENS)}]\s*$")
_FIRST = regex.compile(rf"^\s*({_WORD})")

_AS_LETTER = str.maketrans("0153846Λ", "OISZBAGA")
_AS_DIGIT = str.maketrans("lIi|OoQSsBZzbgqΛ", "1111000558226994")
_NUMBER = r"(?:str\.?\s*|s\.\s*|p\.\s*)?(?:[\[(—–-]\s*)?(?:[0-9lIiOoSsB|](?:\s?[0-9lIiOoSsB|])*|[IVXLCDMl1]+)(?:\s*[\])—–-])?\s*\.?"
_ALONE = regex.compile(rf"\s*({_NUMBER})\s*")
_LEADING = regex.compile(rf"\s*({_NUMBER})\s+(.+)")
_TRAILING = regex.compile(rf"(.+?)\s+({_NUMBER})\s*")
_ROMAN_ENDS = regex.compile(r"^\s*+(?:str\.?|s\.|p\.)?[\s\[(—–-]*+[IVXLCDMl1]++(?!\S*[\p{L}\p{N}])|(?<![\p{L}\p{N}])[IVXLCDMl1]++[\s\])—–.-]*+$")  # the later the page, the longer
_OF_YEAR = regex.compile(r"(\p{L}+) Z ROKU [0-9OISZBAGLQ]{4}")
_PLACE_YEAR = regex.compile(r"(\p{L}+) [0-9OISZBAGLQ]{4}")
_PROSE = regex.compile(r"(?:\p{Ll}{2}.*?){3}")  # a line in small letters, and so no header unless it speaks of a year
_YEAR_HINT = regex.compile(r"(?i)\bz\s+r[o0]ku\b")
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def page_number(said: str) -> int | None:
    """The number that a line or part of it gives, digits or Roman, read through usual misreadings."""
    core = regex.sub(r"^(?:str|s|p)\.?\s*|[\s\[\]()—–.-]", "", said)
    digits = core.translate(_AS_DIGIT)
    if digits.isdigit() and not regex.fullmatch(r"[IVXLCDM]+", core):
        return int(digits) if len(digits) < 19 else None  # a page is a number of 64 bits at most
    core = core.replace("1", "I").replace("l", "I")
    if not core or any(ch not in _ROMAN for ch in core):
        return None
    values = [_ROMAN[ch] for ch in core]
    return sum(-v if k + 1 < len(values) and v < values[k + 1] else v for k, v in enumerate(values))


def _distance(a: str, b: str, most: int) -> int:
    """Plain edit distance, or most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)


def _shape(said: str) -> str:
    """Capitals, letters for digits within words, one blank: how a header is compared."""
    return " ".join(regex.sub(r"[^\p{L}\p{N}]+", " ", said.upper().replace("VV", "W").translate(_AS_LETTER)).split())


@lru_cache(4096)
def _book(title: str) -> tuple[str, str, str]:
    core = _shape(title.split(",")[0])
    return core, core.split(" ")[0] if core else "", core.split(" ")[-1] if core else ""


def _is_header(said: str, title: str) -> bool:
    """The book's title, its kind with a year, or its place with a year."""
    core, kind, place = _book(title)
    shape = _shape(said)
    if not shape or not core:
        return False
    if _distance(shape.replace(" ", ""), core.replace(" ", ""), len(core) // 6) <= len(core) // 6:
        return True
    year = shape.replace(" ", " ")
    if m := _OF_YEAR.fullmatch(year):
        return _distance(m[1], kind, 2) <= 2
    if "," in said and (m := _PLACE_YEAR.fullmatch(year)):
        return m[1] == m[1].upper() and said.upper() == said.translate(str.maketrans("lo", "IO")) and len(m[1]) > 3
    return False


def line_kind(line: str, title: str | None, page: int | None) -> tuple[bool, bool]:
    """(holds a running header, holds a page number). page is the number expected on the page, or null.

    A number alone in a line counts if it is that of the page or of the next one, where a paragraph runs on; if
    none is known, if it stands in dashes or brackets or after str. A number beside a header always counts.
    """
    title = title or ""
    if _PROSE.search(line) and not _YEAR_HINT.search(line) or len(line) > 80 and len(" ".join(_ROMAN_ENDS.sub(" ", line).split())) > 80 + 2 * len(title):  # longer than the title, a year and a number in digits can be
        return False, False
    if m := _ALONE.fullmatch(line):
        n = page_number(m[1])
        if n is None:
            return False, False
        if page is None:
            return False, bool(regex.match(r"\s*(?:[\[(—–-]|str)", line))
        return False, n in (page, page + 1)
    if (m := _LEADING.fullmatch(line)) and page_number(m[1]) is not None and _is_header(m[2], title):
        return True, True
    if (m := _TRAILING.fullmatch(line)) and page_number(m[2]) is not None and _is_header(m[1], title):
        return True, True
    return _is_header(line, title), False


def _nested(rows: list[list[tuple]], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """Rows of tuples as an array of structs."""
    flat = [x for row in rows for x in row]
    columns = list(zip(*flat)) if flat else [()] * len(kinds)
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), structs)


def read_row(par: int | None, text: str, title: str | None, page: int | None) -> tuple:
    """(noise, words, breaks, last_line, last_part, head, has_text, head_line) of a scanned row."""
    noise, lines = [], []
    for n, line in enumerate(text.split("\n"), 1):
        header, number = line_kind(line, title, page)
        if header:
            noise.append((n, "header"))
        if number:
            noise.append((n, "pageno"))
        if not header and not number and line.strip():
            lines.append((n, line))
    words, breaks, carried = [], [], None
    for k, (n, line) in enumerate(lines):
        first = _FIRST.match(line)
        ahead = "\n" + lines[k + 1][1].lstrip()[:1] if k + 1 < len(lines) else ""
        if carried and first:
            breaks.append((*carried, first[1], par, n))
        m = _BROKEN.search(line) if line.rstrip()[-1] in HYPHENS else None
        said = [w.span() for w in _WORDS.finditer(line + ahead)]
        if m:
            said = [w for w in said if w[0] != m.start(1)]
        if carried and first and said and said[0][0] == first.start(1):
            said = said[1:]
        words += [(n, line[a:b]) for a, b in said if a < len(line)]
        carried = (n, m[1]) if m and not (first and m.start(1) == first.start(1) and carried) else None
    head = _FIRST.match(lines[0][1]) if lines else None
    return noise, words, breaks, *(carried or (None, None)), head[1] if head else None, bool(lines), lines[0][0] if lines else None


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each scanned row: its header and number lines, words by line, words that break at a line's end."""
    i, t = pa.int32(), pa.string()
    for batch in batches:
        section, par, *given = (c.to_pylist() for c in batch.columns)
        rows = [read_row(*r) for r in zip(par, *given)]
        noise, words, breaks, *plain = zip(*rows) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), _nested(noise, {"line_n": i, "noise": t}), _nested(words, {"line_n": i, "word": t}),
                _nested(breaks, {"line_n": i, "first": t, "rest": t, "rest_par": i, "rest_line": i}), *(pa.array(c, k) for c, k in zip(plain, (i, t, t, pa.bool_(), i))),
            ],
            names=["section_id", "par_n", "noise", "words", "breaks", "last_line", "last_part", "head", "has_text", "head_line"],
        )


_READING = (
    "section_id long, par_n int, noise array<struct<line_n:int,noise:string>>, words array<struct<line_n:int,word:string>>, "
    "breaks array<struct<line_n:int,first:string,rest:string,rest_par:int,rest_line:int>>, last_line int, last_part string, head string, has_text boolean, head_line int"
)


def scanned(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """Scanned rows without copies, with the page number expected: scan_page and the book's shift."""
    shifts = editions.where("book_title is not null").groupBy("book_title").agg(F.max("page_num_shift").alias("shift"))
    return (
        rows.where("scan_page >= 0 and paragraph is not null")
        .select("section_id", "par_n", "book_title", "scan_page", "paragraph").distinct()
        .join(shifts, "book_title", "left")
        .withColumn("page", (F.col("scan_page") + F.col("shift")).cast("int"))
    )


def readings(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """What each scanned row holds; a word that breaks at the end of a row is joined with the next row that has text."""
    pages = scanned(rows, editions).select("section_id", "par_n", "paragraph", "book_title", "page")
    read = written(pages.mapInArrow(_readings, _READING), "readings")
    slim = read.where("section_id is not null and par_n is not null").select("section_id", "par_n", "last_line", "last_part", F.when(F.col("has_text"), F.struct("head", "par_n", "head_line")).alias("own"))
    at = carry(slim, ["section_id"], F.floor(F.col("par_n") / ROWS), ["par_n", "last_line"], after={"next": F.col("own")})
    over = F.struct(F.col("last_line").alias("line_n"), F.col("last_part").alias("first"), F.col("next.head").alias("rest"), F.col("next.par_n").alias("rest_par"), F.col("next.head_line").alias("rest_line"))
    joined = at.where("last_part is not null and next.head is not null").groupBy("section_id", "par_n").agg(F.max(over).alias("over"))
    return read.join(joined, ["section_id", "par_n"], "left")


def lexicon(rows: DataFrame, read: DataFrame) -> DataFrame:
    """(word, n_clean, n_scanned): lower-case words; also compounds a-b and first parts a- as they stand within lines."""
    clean = rows.where("scan_page < 0 and paragraph is not null").select("section_id", "par_n", "paragraph").distinct()
    patterns = (r"(?U)[\p{L}\p{N}\p{M}]+(?:['’][\p{L}\p{N}\p{M}]+)*", r"(?U)\p{L}+-\p{L}+", r"(?U)\p{L}+-(?=\s\p{Ll})")
    every = lambda text: F.explode(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])))
    of_clean = clean.select(every(F.lower("paragraph")).alias("word")).groupBy("word").agg(F.count("*").alias("n_clean"))
    of_scans = read.select(F.explode("words").alias("w")).groupBy(F.lower("w.word").alias("word")).agg(F.count("*").alias("n_scanned"))
    return of_clean.join(of_scans, "word", "full").na.fill(0, ["n_clean", "n_scanned"])


Weights = dict[str, dict[str, float]]


def listed() -> Weights:
    return {read: {printed: CONFUSED for printed in of} for read, of in CONFUSIONS.items()}


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Random numbers of 64 bits, the same for the same character."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gone(text: str) -> int:
    """What characters that are left out add up to, in whatever order."""
    return int(_mixed(np.array([ord(c) for c in text], np.uint64)).sum(dtype=np.uint64)) if text else 0


_BASE = 0x100000001B3
_BACK = pow(_BASE, -1, 1 << 64)


def delete_keys(words: list[str], wanted: np.ndarray, drops: tuple[str, ...] = ()) -> list[list[tuple[int, int]]]:
    """Of each word the (key, gone) of what stays if up to two characters are left out, where gone, the sum of those, is in wanted (sorted).

    With drops, a place where one of these stands may be left out as well. Keys are rolling hashes, made for
    all words of a length at once; equal keys that stand for different texts are told apart by the distance later.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in words]
    by_length: dict[int, list[tuple[int, str, int]]] = {}
    for i, w in enumerate(words):
        if w is None or len(w) > LONGEST:
            continue
        by_length.setdefault(len(w), []).append((i, w, 0))
        for d in drops:
            at = w.find(d)
            while at >= 0:
                by_length.setdefault(len(w) - len(d), []).append((i, w[:at] + w[at + len(d) :], _gone(d)))
                at = w.find(d, at + 1)
    power = np.cumprod(np.array([1] + [_BASE] * LONGEST, np.uint64), dtype=np.uint64)
    back = np.uint64(_BACK)
    for n, own in by_length.items():
        places = np.array([i for i, _, _ in own])
        base = np.array([g for _, _, g in own], np.uint64)
        h = _mixed(np.array([[ord(c) for c in w] for _, w, _ in own], np.uint64).reshape(len(own), n))
        sums = np.zeros((len(own), n + 1), np.uint64)
        np.cumsum(h * power[:n], axis=1, dtype=np.uint64, out=sums[:, 1:])

        def add(keys: np.ndarray, gone: np.ndarray, places=places) -> None:
            at = np.minimum(np.searchsorted(wanted, gone), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == gone) if len(wanted) else ()
            for k in hit:
                out[places[k]].append((int(keys[k].view(np.int64)), int(gone[k].view(np.int64))))

        whole = sums[:, n]
        add(whole, base)
        for i in range(n):
            once = sums[:, i] + (whole - sums[:, i + 1]) * back
            add(once, base + h[:, i])
            for j in range(i + 1, n):
                add(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * back + (whole - sums[:, j + 1]) * back * back, base + h[:, i] + h[:, j])
    return [sorted(set(x)) for x in out]


_KEYS = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("gone", T.LongType())]))


def _keys_of(wanted: np.ndarray, drops: tuple[str, ...] = ()):
    @arrow_udf(_KEYS)
    def keys(words: pa.Array) -> pa.Array:
        return _nested(delete_keys(words.to_pylist(), wanted, drops), {"key": pa.int64(), "gone": pa.int64()})

    return keys


def confused_sums(weights: Weights) -> list[tuple[int, int]]:
    """(gone of what was read, gone of what was printed) of one confusion, or of two that together cost no more than MOST."""
    pairs = [(_gone(read), _gone(printed), cost) for read, of in weights.items() for printed, cost in of.items()]
    two = [(a + c & _ALL, b + d & _ALL) for k, (a, b, x) in enumerate(pairs) for c, d, y in pairs[k:] if x + y <= MOST]
    return sorted({*[(a, b) for a, b, x in pairs if x <= MOST], *two})


_ALL = (1 << 64) - 1


def learnt(known: DataFrame, doubtful: DataFrame) -> Weights:
    """Pairs of letters that misread words show: (word, n) that are known, and (word, own) that no unscanned text holds.

    Words that differ in one letter meet by what is left of them, with the place open, so no place has more words than
    there are letters. A pair counts where the known word is TIMES as frequent. What known words differ by among themselves
    is how words differ anyway: the pair's cost falls from MOST to CONFUSED the more it is over that.
    """
    open_place = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.struct(F.concat(F.substring(c, F.lit(1), i - 1), F.lit("\x01"), F.substring(c, i + 1, F.length(c))).alias("rest"), F.substring(c, i, F.lit(1)).alias("letter"))))
    at = lambda df, n: df.where(F.length("word").between(4, LONGEST)).select("word", F.col(n).alias("n"), open_place(F.col("word")).alias("p")).select("n", "p.rest", "p.letter")
    own = written(at(known, "n"), "open")
    read = at(doubtful, "own").select("rest", F.col("letter").alias("read"), F.col("n").alias("own"))
    printed = own.select("rest", F.col("letter").alias("printed"), "n")
    shown = read.join(printed, "rest").where(f"read <> printed and n >= own * {TIMES}").groupBy("read", "printed").agg(F.count("*").alias("shown")).where(F.col("shown") >= SHOWN)
    usual = own.select("rest", F.col("letter").alias("read")).join(printed, "rest").where("read <> printed").groupBy("read", "printed").agg(F.count("*").alias("usual"))
    sizes = known.agg(F.count("*").alias("n_known")).crossJoin(doubtful.agg(F.count("*").alias("n_doubtful")))  # one row each
    lift = (F.col("shown") / F.col("n_doubtful")) / ((F.coalesce("usual", F.lit(0)) + 1) / F.col("n_known"))
    rows = shown.join(usual, ["read", "printed"], "left").crossJoin(sizes).select("read", "printed", lift.alias("lift")).where(F.col("lift") >= LIFT).collect()  # pairs of letters
    out: Weights = {}
    for r in rows:
        out.setdefault(r["read"], {})[r["printed"]] = CONFUSED + (MOST - CONFUSED) * LIFT / r["lift"]
    return out


def merged(*several: Weights) -> Weights:
    """The cheapest of the given costs of each pair."""
    out: Weights = {}
    for weights in several:
        for read, of in weights.items():
            for printed, cost in of.items():
                own = out.setdefault(read, {})
                own[printed] = min(cost, own.get(printed, cost))
    return out


def misreading_cost(read: str, printed: str, weights: Weights) -> float:
    """Edit distance from what was read to what was printed: confusions cost what they weigh, any other edit of a character OTHER."""
    n, m = len(read), len(printed)
    widest = max(map(len, weights), default=1)
    cost = [[(i + j) * OTHER for j in range(m + 1)] for i in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            best = cost[i][j]
            if i:
                best = min(best, cost[i - 1][j] + OTHER)
            if j:
                best = min(best, cost[i][j - 1] + OTHER)
            if i and j:
                best = min(best, cost[i - 1][j - 1] + (0.0 if read[i - 1] == printed[j - 1] else OTHER))
                for k in range(1, min(widest, i) + 1):
                    if (own := weights.get(read[i - k : i])) and printed[j - 1] in own:
                        best = min(best, cost[i - k][j - 1] + own[printed[j - 1]])
            cost[i][j] = best
    return cost[n][m]


def _cost_of(weights: Weights):
    @arrow_udf(T.DoubleType())
    def cost(read: pa.Array, printed: pa.Array) -> pa.Array:
        return pa.array([misreading_cost(a, b, weights) for a, b in zip(read.to_pylist(), printed.to_pylist())], pa.float64())

    return cost


@arrow_udf(T.IntegerType())
def _first_difference(read: pa.Array, printed: pa.Array) -> pa.Array:
    return pa.array([next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(read.to_pylist(), printed.to_pylist())], pa.int32())


def broken_words(read: DataFrame, words: DataFrame) -> DataFrame:
    """(section_id, par_n, line_n, first, rest, rest_par, rest_line, joined): words that break at a line's end.

    A hyphen belongs to the word if the compound stands within lines more often than the joined word does, or
    if only the first part with its hyphen does (as before "and"); otherwise the word is broken.
    """
    of = F.concat(F.coalesce("breaks", F.array()), F.when(F.col("over").isNotNull(), F.array("over")).otherwise(F.array()))
    at = read.select("section_id", "par_n", F.explode(of).alias("b")).select("section_id", "par_n", "b.*").withColumn("joined", F.concat("first", "rest"))
    n = lambda key, name: words.select(F.col("word").alias(key), (F.col("n_clean") + F.col("n_scanned")).alias(name))
    keyed = at.withColumns({"k1": F.lower("joined"), "k2": F.lower(F.concat("first", F.lit("-"), "rest")), "k3": F.lower(F.concat("first", F.lit("-")))})
    seen = keyed.join(n("k1", "n1"), "k1", "left").join(n("k2", "n2"), "k2", "left").join(n("k3", "n3"), "k3", "left").na.fill(0, ["n1", "n2", "n3"])
    own = (F.col("n2") > F.col("n1")) | ((F.col("n3") > 0) & (F.col("n1") == 0))
    letters = F.col("first").rlike(r"\p{L}") & F.col("rest").rlike(r"\p{L}")  # else it is a span of numbers
    return seen.where(~own & letters).drop("k1", "k2", "k3", "n1", "n2", "n3")


_DIGIT_LETTERS = ("0135689", "olesbbg")


def repairs(read: DataFrame, words: DataFrame, broken: DataFrame) -> DataFrame:
    """(word, repair, cost, n): every misread word in lower case with its candidates.

    Words of unscanned text are the known ones. The symmetric-delete index holds each word of the lexicon that can be
    a repair, with up to two characters left out; a word that no unscanned text holds is looked up with up to two
    left out, and besides without a group of characters that is read for one. So any two confusions meet, also of two
    or three characters for one. Left out are only characters that are confused, and pairs stay if what both lack
    is that of one or two confusions. Of these, words whose weighted distance is at most MOST are candidates, if
    known or TIMES as frequent. A word of letters and digits without any candidate gets letters for its digits.
    """
    extra = broken.groupBy(F.lower("joined").alias("word")).agg(F.count("*").alias("n_joined"))
    every = words.where("word not like '%-%'").join(extra, "word", "full").na.fill(0, ["n_clean", "n_scanned", "n_joined"])
    every = written(every.select("word", "n_clean", (F.col("n_scanned") + F.col("n_joined")).alias("n_scanned")), "lexicon")
    doubtful = every.where((F.col("n_clean") == 0) & (F.length("word") >= SHORTEST) & F.col("word").rlike(r"\p{L}")).select("word", F.col("n_scanned").alias("own"))
    stems = every.where("n_clean > 0").select(F.concat("word", F.lit("!")).alias("word"))  # a real exclamation mark
    doubtful = doubtful.join(stems, "word", "left_anti")
    letters = every.where((F.length("word") >= SHORTEST) & ~F.col("word").rlike(r"\p{N}"))
    weights = merged(listed(), learnt(letters.where("n_clean > 0").select("word", (F.col("n_clean") + F.col("n_scanned")).alias("n")), doubtful))
    sums = confused_sums(weights)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    confused = every.sparkSession.createDataFrame([(signed(a), signed(b)) for a, b in sums], "gone long, gone_too long")
    side = lambda k: np.unique(np.array([0, *(x[k] for x in sums)], np.uint64))
    groups = tuple(sorted(x for x in weights if len(x) > 1))
    able = letters.where(f"n_clean > 0 or n_scanned >= {TIMES}")  # no other is so many times as frequent as a word that occurs
    index = able.select(F.col("word").alias("repair"), "n_clean", F.col("n_scanned").alias("n"), F.explode(_keys_of(side(1))("word")).alias("k")).select("repair", "n_clean", "n", "k.key", F.col("k.gone").alias("gone_too"))
    asked = doubtful.select("word", "own", F.explode(_keys_of(side(0), groups)("word")).alias("k")).select("word", "own", "k.key", "k.gone")
    near = (
        asked.join(index, "key").where(f"word <> repair and (n_clean > 0 or n >= own * {TIMES})")
        .join(F.broadcast(confused), ["gone", "gone_too"], "left_semi")  # one or two of the listed pairs, or one that was learnt: a few thousand rows
        .select("word", "repair", (F.col("n_clean") + F.col("n")).alias("n")).distinct()
        .withColumn("cost", _cost_of(weights)("word", "repair")).where(F.col("cost") <= MOST)
    )
    digits = (
        doubtful.where(F.col("word").rlike(r"\p{N}") & F.col("word").rlike(r"\p{L}{2}"))
        .join(near.select("word").distinct(), "word", "left_anti")
        .select("word", F.translate("word", *_DIGIT_LETTERS).alias("repair"), F.lit(0).cast("long").alias("n"), F.lit(MOST).alias("cost"))
    )
    return near.unionByName(digits)


def _bigrams(rows: DataFrame, read: DataFrame) -> DataFrame:
    """(before, word), lower case, of neighbours within a line or an unscanned paragraph."""
    said = F.regexp_extract_all(F.lower("paragraph"), F.lit(r"(?U)[\p{L}\p{N}\p{M}]+(?:['’][\p{L}\p{N}\p{M}]+)*"), F.lit(0))
    clean = rows.where("scan_page < 0 and paragraph is not null").select("section_id", "par_n", "paragraph").distinct().select(said.alias("w"))
    scans = read.select(F.transform("words", lambda x: F.lower(x["word"])).alias("w"))
    both = clean.unionByName(scans).where(F.size("w") > 1)
    return both.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("before"), F.expr("slice(w, 2, size(w) - 1)").alias("word"))).alias("p")).select("p.before", "p.word")


def misread(rows: DataFrame, read: DataFrame, words: DataFrame, broken: DataFrame) -> DataFrame:
    """(section_id, par_n, line_n, rest_line, word, repair): each misread word where it stands, with the repair that its neighbour favours."""
    candidates = written(repairs(read, words, broken), "repairs")
    within = read.select("section_id", "par_n", F.posexplode("words").alias("k", "w"), "words").select(
        "section_id", "par_n", F.col("w.line_n").alias("line_n"), F.lower("w.word").alias("word"), F.col("w.word").alias("said"),
        F.when(F.col("k") > 0, F.lower(F.get("words", F.col("k") - 1)["word"])).alias("before"), F.lit(None).cast("string").alias("first"),
        F.lit(None).cast("int").alias("rest_par"), F.lit(None).cast("int").alias("rest_line"),
    )
    split = broken.select("section_id", "par_n", "line_n", F.lower("joined").alias("word"), F.col("joined").alias("said"), F.lit(None).cast("string").alias("before"), "first", "rest_par", "rest_line")
    at = within.unionByName(split).join(candidates, "word")
    asked = at.where("before is not null").select("before", F.col("repair").alias("word")).distinct()
    seen = _bigrams(rows, read).join(asked, ["before", "word"], "left_semi").groupBy("before", "word").agg(F.count("*").alias("together"))
    best = F.max(F.struct(F.coalesce("together", F.lit(0)), (-F.col("cost")).alias("near"), "n", "repair"))
    place = ["section_id", "par_n", "line_n", "word", "said", "first", "rest_par", "rest_line"]
    return at.join(seen.withColumnRenamed("word", "repair"), ["before", "repair"], "left").groupBy(*place).agg(best.alias("b")).select(*place, F.col("b.repair").alias("repair"))


def noise(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """(section_id, par_n, line_n, noise) of the scanned rows: header, pageno, hyphen, char.

    Copies count once. Null and empty paragraphs and rows without scan_page give nothing; a book that editions
    does not hold has no expected page numbers.
    """
    read = written(readings(rows, editions), "read")
    words = written(lexicon(rows, read), "words")
    broken = written(broken_words(read, words), "broken")
    wrong = misread(rows, read, words, broken)
    late = F.col("first").isNotNull() & (_first_difference("word", "repair") >= F.length("first"))
    chars = wrong.select("section_id", F.when(late, F.col("rest_par")).otherwise(F.col("par_n")).alias("par_n"), F.when(late, F.col("rest_line")).otherwise(F.col("line_n")).alias("line_n"))
    lines = read.select("section_id", "par_n", F.explode("noise").alias("x")).select("section_id", "par_n", "x.line_n", "x.noise")
    return (
        lines.unionByName(broken.select("section_id", "par_n", "line_n", F.lit("hyphen").alias("noise")))
        .unionByName(chars.select("section_id", "par_n", "line_n", F.lit("char").alias("noise")))
        .distinct()
    )


def found(rows: DataFrame, editions: DataFrame) -> DataFrame:
    return noise(rows, editions)


def _cased(repair: str, said: str) -> str:
    return repair.upper() if said.isupper() and len(said) > 1 else repair[:1].upper() + repair[1:] if said[:1].isupper() else repair


def repaired_lines(text: str, noisy: set[int], wrong: dict[tuple[int, str], str], broken: dict[int, str], drop_head: bool) -> str:
    """The lines of a row as running text: without noisy lines, words replaced, broken words whole in their first line."""
    out, skip = [], drop_head
    for n, line in enumerate(text.split("\n"), 1):
        if n in noisy or not line.strip():
            continue
        if skip:
            line = _FIRST.sub("", line, count=1)
        skip = n in broken
        tail = ""
        if skip and (m := _BROKEN.search(line)):
            line, tail = line[: m.start()], broken[n]
        said = _WORDS.sub(lambda w: _cased(wrong[n, w[0]], w[0]) if (n, w[0]) in wrong else w[0], line + " ") if wrong else line
        out.append((said.strip() + (" " if said.strip() and not said.rstrip()[-1:] in "„«“\"(" else "") + tail).strip())
    return regex.sub(r" (?=[,.;:!?…](?:\s|$))", "", " ".join(x for x in out if x))


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    listed = lambda x: [] if x is None else x
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            noisy = {x["line_n"] for x in listed(r.noise)}
            wrong = {(x["line_n"], x["said"]): x["repair"] for x in listed(r.wrong)}
            broken = {x["line_n"]: x["whole"] for x in listed(r.broken)}
            out.append((r.section_id, r.par_n, repaired_lines(r.paragraph, noisy, wrong, broken, bool(r.drop_head))))
        yield pd.DataFrame(out, columns=["section_id", "par_n", "text"]).astype({"section_id": "Int64", "par_n": "Int32"})


def continuous_text(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """(section_id, par_n, last_par_n, text): the paragraphs of scanned sections as running text.

    Rows that go on into the next row (they end in the middle of a sentence, and the next begins with a small
    letter) are one paragraph, par_n its first row. Headers and page numbers are gone, broken words whole,
    misread words repaired. Rows of nothing but noise give no text. Copies count once; different rows with one place
    are one paragraph, rows without section or place give no text.
    """
    read = written(readings(rows, editions), "read")
    words = written(lexicon(rows, read), "words")
    broken = written(broken_words(read, words), "broken")
    wrong = written(misread(rows, read, words, broken), "wrong")
    keys = ["section_id", "par_n"]
    cased = F.when((F.upper("joined") == F.col("joined")) & (F.length("joined") > 1), F.upper("repair")).when(F.substring("joined", 1, 1) != F.lower(F.substring("joined", 1, 1)), F.concat(F.upper(F.substring("repair", 1, 1)), F.expr("substring(repair, 2)"))).otherwise(F.col("repair"))
    fixes = wrong.where("first is null").groupBy(*keys).agg(F.collect_set(F.struct("line_n", "said", "repair")).alias("wrong"))
    of_broken = wrong.where("first is not null").select(*keys, "line_n", "repair").dropDuplicates([*keys, "line_n"])
    whole = broken.join(of_broken, [*keys, "line_n"], "left").withColumn("whole", F.coalesce(cased, "joined"))
    parts = whole.groupBy(*keys).agg(F.collect_set(F.struct("line_n", "whole")).alias("broken"))
    heads = broken.where("rest_par <> par_n").select("section_id", F.col("rest_par").alias("par_n"), F.lit(True).alias("drop_head")).distinct()
    pages = scanned(rows, editions).select(*keys, "paragraph").join(read.select(*keys, "noise"), keys)
    text = pages.join(fixes, keys, "left").join(parts, keys, "left").join(heads, keys, "left").mapInPandas(_repaired, "section_id long, par_n int, text string").where("text <> ''")
    text = written(text.where("section_id is not null and par_n is not null").groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text")), "texts")
    block = F.floor(F.col("par_n") / ROWS)
    joins = F.col("begin").rlike(r"^[\p{Ll}\p{N},;]") & ~F.col("open").rlike(r"[.!?…։。！？][\"'”’»“«)\]]*$")
    slim = carry(text.select(*keys, F.substring("text", 1, 1).alias("begin"), F.expr("right(text, 4)").alias("end")), ["section_id"], block, ["par_n"], before={"open": F.col("end")})
    groups = carry(slim, ["section_id"], block, ["par_n"], upto={"paragraph_n": (~F.coalesce(joins, F.lit(False))).cast("int")}).select(*keys, "paragraph_n")
    return (
        text.join(groups, keys).groupBy("section_id", "paragraph_n")
        .agg(F.min("par_n").alias("par_n"), F.max("par_n").alias("last_par_n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("par_n", "text"))), lambda x: x["text"]), " ").alias("text"))
        .drop("paragraph_n")
    )
