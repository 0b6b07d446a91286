"""Texts that look the same: a skeleton of prototypes, and groups of equal skeletons."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..session import written

#: Kinds of compatibility decomposition that change the drawing only in width, joining or design.
SAME_TO_THE_EYE = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


#: Scripts whose letters a word of prototypes is given back.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u180b\u180c\u180d\u180f"
_WORD = re.compile(r"(\W+)")


def _script_of(ch: str) -> str:
    return (unicodedata.name(ch, "").split(" ") or [""])[0]


class Looks:
    """The look-alike letters in classes, and the forms of texts that follow from them.

    classes are strings of letters that are drawn alike; the first of each is the prototype, and `common` has
    the letters that are in use in an alphabet of today.
    """

    def __init__(self, classes: Sequence[str], common: Iterable[str]) -> None:
        self.classes, self.common = tuple(classes), frozenset(common)
        self._to = {x: c[0] for c in self.classes for x in c[1:]}
        self._table = _Table(self._prototype)
        in_use = {c: {_script_of(x) for x in c if x in self.common} & set(SCRIPTS) for c in self.classes}
        self._doubtful = {x for c, scripts in in_use.items() if len(scripts) > 1 for x in c}
        self._back = {s: {ord(c[0]): own for c in self.classes if (own := self._of_script(c, s)) and own != c[0]} for s in SCRIPTS[1:]}
        self._script, self._in_script = lru_cache(1 << 16)(self._find_script), lru_cache(1 << 16)(self._write_in_script)

    def __reduce__(self):
        return _restored, (self.classes, "".join(sorted(self.common & set("".join(self.classes)))))

    def _of_script(self, letters: str, script: str) -> str | None:
        own = [x for x in letters if _script_of(x) == script]
        return min(own, key=lambda x: (x not in self.common, x)) if own else None

    def _prototype(self, ch: str) -> str:
        """What ch is drawn as: "" for an invisible character, one blank for any blank, prototypes of letters."""
        category = unicodedata.category(ch)
        if ch in "\n\r\u2028\u2029\u0085\u000b\u000c":
            return "\n"
        if ch == "\t" or category == "Zs":
            return " "
        if category in ("Cf", "Cc") or ch in _INVISIBLE or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
            return ""
        kind, _, parts = unicodedata.decomposition(ch).rpartition(">")
        if parts and (not kind or kind + ">" in SAME_TO_THE_EYE):
            return "".join(self._prototype(chr(int(x, 16))) for x in parts.split())
        return self._to.get(ch, ch)

    def skeleton(self, text: str | None) -> str | None:
        """Decomposed, every character replaced by its prototype, decomposed again. Null stays null."""
        if text is None:
            return None
        return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text.replace("\r\n", "\n")).translate(self._table))

    def _find_script(self, word: str) -> str | None:
        """The script of the letters of a word that are drawn like no letter of another script; null if there are none."""
        own = Counter(s for ch in word if ch not in self._doubtful and (s := _script_of(ch)) in SCRIPTS)
        return min(own, key=lambda s: (-own[s], s)) if own else None

    def _write_in_script(self, word: str, script: str) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(self._back[script]))

    def one_form(self, text: str | None) -> str | None:
        """The text in one form for further use: composed, one kind of blank, nothing invisible, each word in one script.

        It depends on the skeleton alone, so texts that look the same get the same form. Prototypes turn back into
        the letters of a word's script; a word of nothing but look-alikes takes the script of the word before it.
        """
        if text is None:
            return None
        words = _WORD.split(unicodedata.normalize("NFC", self.skeleton(text)))
        script = next((s for w in words if (s := self._script(w))), "LATIN")
        for i in range(0, len(words), 2):
            script = self._script(words[i]) or script
            if script in self._back:
                words[i] = self._in_script(words[i], script)
        return "".join(words)


class _Table(dict):
    """A table for str.translate that is filled as characters are met."""

    def __init__(self, of) -> None:
        super().__init__()
        self._of = of

    def __missing__(self, code: int) -> str:
        self[code] = to = self._of(chr(code))
        return to


@lru_cache(2)
def _restored(classes: tuple[str, ...], common: str) -> Looks:
    """One object in each Python worker."""
    return Looks(classes, common)


def classes_of(letters: Sequence[str], drawn: Sequence[str], common: frozenset[str]) -> list[str]:
    """Classes of letters by what they are drawn as, the prototype first: in use rather than not, then by code point.

    Case differs to the eye, so capitals and small letters are never of one class; a letter without case goes
    with the case of what it is drawn as. Two letters of one script that are both in use are different letters:
    only the first of them stays in the class.
    """
    by: dict[tuple[str, bool], list[str]] = {}
    for x, said in zip(letters, drawn):
        kind = unicodedata.category(x)
        capital = kind in ("Lu", "Lt") or kind not in ("Ll",) and said[:1] != said[:1].lower()
        by.setdefault((said, capital), []).append(x)
    out = []
    for own in by.values():
        seen: set[str] = set()
        kept = []
        for x in sorted(own, key=lambda x: (x not in common, x)):
            if x not in common or (script := _script_of(x)) not in seen:
                kept.append(x)
                seen |= {script} if x in common else set()
        if len(kept) > 1:
            out.append("".join(kept))
    return out


def looks(spark: SparkSession) -> Looks:
    """The classes of the public confusables table (Unicode Technical Standard 39), read from the Unicode library that comes with Spark.

    Of the table only letters are taken, since another digit, mark or accent makes a visible difference, and of
    these only such as do not decompose; ligatures, widths and designs of a letter decompose anyway.
    """
    global _looks
    if _looks is None:
        icu = spark._jvm.com.ibm.icu.text
        letters = [ch for ch in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(ch)[0] == "L" and not unicodedata.decomposition(ch)]
        drawn = getattr(icu, "SpoofChecker$Builder")().build().getSkeleton("\n".join(letters)).split("\n")
        use = icu.SpoofChecker.RECOMMENDED
        common = frozenset(chr(c) for k in range(use.getRangeCount()) for c in range(use.getRangeStart(k), use.getRangeEnd(k) + 1))
        _looks = Looks(classes_of(letters, drawn, common), common)
    return _looks


_looks: Looks | None = None


def _each(f: Callable[[str | None], str | None]):
    @arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(map(f, texts.to_pylist()), pa.string())

    return run


def text_forms(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, look): the text in one form, and the SHA-256 of its skeleton, equal where texts look the same.

    A null text has null form and look; an empty text has empty ones. All rows come out, repeated rows as often.
    """
    own = looks(documents.sparkSession)
    return documents.select(F.col(key), _each(own.one_form)(text).alias("form"), _digest(_each(own.skeleton)(text)).alias("look"))


def _digest(c: Column | str) -> Column:
    return F.sha2(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"), 256)


def look_classes(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look, exact): digests of the skeleton and of the text itself. Rows with a null text are left out."""
    return documents.where(F.col(text).isNotNull()).select(F.col(key), _digest(_each(looks(documents.sparkSession).skeleton)(text)).alias("look"), _digest(text).alias("exact")).distinct()


def look_alike_pairs(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), the smaller first: texts with equal skeletons that are not the same code points.

    Classes of equal skeleton with a single text, however often it is repeated, are dropped before any pair is
    made; other pairs are made between the different texts of a class and then given to their documents, so
    exact copies never meet each other.
    """
    rows = written(look_classes(documents, key=key, text=text), "looks")  # digests in place of texts
    several = rows.groupBy("look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("look")
    members = rows.join(several, "look", "left_semi")
    texts = members.select("look", "exact").distinct()
    pairs = texts.withColumnRenamed("exact", "exact_a").join(texts.withColumnRenamed("exact", "exact_b"), "look").where("exact_a < exact_b")
    of = lambda x: members.select("look", F.col("exact").alias(f"exact_{x}"), F.col(key).alias(f"_{x}"))
    return pairs.join(of("a"), ["look", "exact_a"]).join(of("b"), ["look", "exact_b"]).select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"))


def look_groups(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look, n_documents, n_texts): each document with its class of equal looks, the documents in it and their different texts.

    A row for each document, however many copies a class has. Null texts are left out; repeated rows come once.
    """
    rows = written(look_classes(documents, key=key, text=text), "looks")
    by_text = rows.groupBy("look", "exact").agg(F.count("*").alias("n"))
    sizes = by_text.groupBy("look").agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_texts"))
    return rows.join(sizes, "look").select(key, "look", "n_documents", "n_texts")


def found(documents: DataFrame) -> DataFrame:
    return look_alike_pairs(documents)
