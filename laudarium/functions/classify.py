"""What a paragraph is: an editor's note, a heading, the beginning of a document; all as native expressions.

Each takes a column of text and gives null for null, except where it says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import (
    HEADING_AGAINST,
    HEADING_FIRST,
    HEADING_SECOND,
    META_SIGNS,
    NEAR_TITLES,
    OCR_REPAIRS,
    OPENING,
    OPENING_WORDS,
    OTHER_TITLES,
    RESOLUTION_TITLES,
    any_of,
    number_of,
    rx,
)

_UPPER_FIRST = lambda c: F.substring(c, 1, 1) != F.lower(F.substring(c, 1, 1))


def words(text: Column) -> Column:
    """Split at single white space, empty strings left out."""
    return F.filter(F.split(text, rx(r"\s")), lambda w: w != "")


def ocr_corrected(text: Column) -> Column:
    return reduce(lambda t, pair: F.regexp_replace(t, F.lit(rx(pair[0])), F.lit(pair[1])), OCR_REPAIRS, text)


def meta_reason(text: Column, max_line: int = 200) -> Column:
    """Why a paragraph is an editor's note, by the first rule that holds; null if it is none."""
    n, said = F.length(text), words(text)
    short = F.size(F.filter(said, lambda w: F.length(w) <= 2))
    capital = F.exists(said, lambda w: (F.length(w) > 3) & w.rlike("[IVXLCM]") & (w == F.upper(w)) & (w != F.lower(w)))
    odd = F.size(F.filter(said, lambda w: _UPPER_FIRST(w) | w.rlike(rx(r"[\W0-9]"))))
    titled = any_of(text, RESOLUTION_TITLES + OTHER_TITLES + NEAR_TITLES)
    kinds = F.size(F.array_distinct(F.filter(F.split(F.lower(text), ""), lambda c: c != "")))
    times = lambda p: F.size(F.regexp_extract_all(text, F.lit(rx(p)), F.lit(0)))
    rules = [
        ("short", n < 9),
        ("long line", F.exists(F.split(text, "\n"), lambda line: F.length(line) > max_line)),
        ("sign", (n < 800) & any_of(text, META_SIGNS)),
        ("not letters", F.length(F.regexp_replace(text, r"(?dU)[\w&&[^0-9]]", "")) / n >= 0.65),
        ("short words", (F.size(said) >= 4) & (short > 0.48 * F.size(said))),
        ("capital word", (F.size(said) < 10) & capital),
        ("capitals", ~titled & (F.size(said) >= 3) & (odd > 0.85 * F.size(said))),
        ("footnotes", (n < 380) & (times(r"(((^| ).)|(. ))\)") >= 2)),
        ("few characters", n.between(2, 16) & (kinds <= F.greatest(F.lit(2.0), n / 3))),
        ("abbreviations", times(r"\b[A-Za-z]{1,5}\.") > F.size(F.split(text, " ")) * 0.33),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(rule, name)
    return out


def heading_score(text: Column, max_len: Column | int = 300, discount: float = 70) -> Column:
    """Above 0 for what looks like a heading: signs less signs against, less the length by discount."""
    bare = F.replace(text, F.lit("-"), F.lit(""))
    first, second, against = number_of(bare, HEADING_FIRST), number_of(bare, HEADING_SECOND), number_of(bare, HEADING_AGAINST)
    letter = F.regexp_extract(bare, rx(r"[^\W\d_]"), 0)
    low = F.when((letter == "") | (F.lower(letter) == letter), 1.0).otherwise(0.0)
    score = (first + (second - F.when(first == 0, 1.5).otherwise(0.0))) - (against * 0.6 + low) - F.length(bare) / F.lit(float(discount))
    limit = F.lit(max_len) if isinstance(max_len, int) else max_len
    return F.when((F.length(text) < 15) | (F.length(text) > limit), -1.5).otherwise(score)


def opening(text: Column) -> Column:
    return text.rlike(rx(OPENING))


def beginning_score(text: Column) -> Column:
    """How likely a paragraph begins a document; of the words of the formula only one at the very beginning fails to count."""
    at_start = reduce(lambda a, b: a + b, [F.startswith(F.lower(text), F.lit(w)).cast("int") for w in OPENING_WORDS])
    n = len(OPENING_WORDS)
    return F.when(opening(text) | _UPPER_FIRST(text), -0.2 + 0.3 * (n - at_start) / n).otherwise(-0.5)


def pertinent(n_paragraphs: Column, second: Column, third: Column, title: Column) -> Column:
    """Whether a section is a resolution of an assembly, by its first paragraphs and its title. Never null."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(F.coalesce(n_paragraphs, F.lit(0)) <= 1, False)
        .when(yes(F.contains(second, F.lit("sędziowie"))), False)
        .when(yes(opening(second)), True)
        .when(yes(opening(third)), True)
        .otherwise(yes(any_of(title, RESOLUTION_TITLES)))
    )


def match_key(text: Column) -> Column:
    """Texts match if their keys are equal: white space and the two characters \\n left out."""
    return F.regexp_replace(text, rx(r"\s|\\n"), "")


def joined_lines(text: Column) -> Column:
    """Lines joined by blanks (one in front, too); a hyphen before a small letter goes; so does a lone last consonant, but for the first line's."""
    def step(so_far: Column, line: Column) -> Column:
        clean = F.when(line.rlike(rx(" [^aeikouwyz]$")), F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
        head = F.substring(clean, 1, 1)
        small = (head != F.upper(head)) & (head == F.lower(head))
        return (
            F.when(so_far == "", F.concat(F.lit(" "), line))
            .when(F.endswith(so_far, F.lit("-")) & small, F.concat(F.substring(so_far, F.lit(1), F.length(so_far) - 1), clean))
            .otherwise(F.concat(so_far, F.lit(" "), clean))
        )

    return F.when(text.isNotNull(), F.aggregate(F.split(text, "\n"), F.lit(""), step))
