"""Dates in running text of the 16th to 18th centuries, and dates as they are stored."""

from __future__ import annotations

import datetime
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .patterns import MONTH_CUES, MONTHS

FIRST_YEAR, LAST_YEAR = 1500, 1795
# The months in Roman numerals of at most three signs, strictly written.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "IX": 9, "X": 10, "XI": 11, "XII": 12}

_WORD, _NUMERAL = re.compile(MONTHS), re.compile("[xXvViI]{1,3}")
DATE = T.StructType([T.StructField(x, T.IntegerType()) for x in ("day", "month", "year")])


def _month(found: str) -> int | None:
    if _NUMERAL.match(found):
        return ROMAN.get(found)
    spelled = found.replace("i", "j")
    return next((n for cue, n in MONTH_CUES if cue in spelled), None)


def _day_fits(day: int, month: int) -> bool:
    return day <= (29 if month == 2 else 30 if month in (4, 6, 9, 11) else 31)


def _year_fits(year: int) -> bool:
    return FIRST_YEAR <= year <= LAST_YEAR


def _gap_after(text: str, end: int) -> int:
    """Place of the next blank or line end; one before the end of the month if there is none."""
    gaps = [g for g in (text.find(" ", end), text.find("\n", end)) if g >= 0]
    return min(gaps) if gaps else end - 1


def _gap_before(text: str, start: int, end: int) -> int:
    return max(text.rfind(" ", 0, start), text.rfind("\n", 0, end))


def _around(text: str, start: int, end: int, month: int) -> tuple[int, int, int] | None:
    """The date to which a month belongs: day month year, month day year, or year month day."""
    after = _gap_after(text, end)
    number = re.search(r"\d{1,4}", text[after + 1 : after + 5]) if after != -1 else None
    if number is None or len(number[0]) == 3:
        return None
    value, before = int(number[0]), _gap_before(text, start, end)
    if len(number[0]) < 4 and _day_fits(value, month):
        from_here = after + 1 + len(number[0])
        year = re.search(r"\d{4}", text[from_here + 1 : from_here + 19])
        if year and int(year[0]) != 0:
            if _year_fits(int(year[0])):
                return value, month, int(year[0])
            value = 0  # the day goes with its year
        if before == -1:
            return None
        said = text[before - 4 : before] if before >= 4 else ""
        if not re.fullmatch(r"\d+", said) or not _year_fits(int(said)) or not value:
            return None
        return value, month, int(said)
    if before == -1:
        return None
    day = re.search(r"\d+", text[max(before - 3, 0) : before])
    if day is None or not _day_fits(int(day[0]), month) or not int(day[0]):
        return None
    return (int(day[0]), month, value) if len(number[0]) == 4 and _year_fits(value) else None


def dates_in(text: str | None) -> list[tuple[int, int, int]]:
    """(day, month, year) of the dates in text: those with month words first, then those with Roman numerals, in order."""
    if not text:
        return []
    out = []
    for m in [*_WORD.finditer(text.lower()), *_NUMERAL.finditer(text)]:
        month = _month(m.group())
        date = _around(text, m.start(), m.end(), month) if month else None
        if date:
            try:
                datetime.date(date[2], date[1], date[0])
            except ValueError:
                continue
            out.append(date)
    return out


@arrow_udf(T.ArrayType(DATE))
def extract_dates(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("day", "month", "year")]))
    return pa.array([[dict(zip(("day", "month", "year"), d)) for d in dates_in(t)] for t in texts.to_pylist()], kind)


def to_date(day: Column, month: Column, year: Column) -> Column:
    """Null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def stored_date(text: Column) -> Column:
    """A date written as (d, m, y); anything else, False and impossible days among it, is null."""
    part = lambda k: F.try_element_at(F.split(F.regexp_extract(text, r"^.(.*).$", 1), ","), F.lit(k))
    number = lambda k: F.trim(part(k)).try_cast("int")
    whole = F.size(F.split(text, ",")) == 3
    return F.when(whole & number(1).isNotNull() & number(2).isNotNull() & number(3).isNotNull(), to_date(number(1), number(2), number(3)))


def earliest(dates: Column) -> Column:
    """Of the dates in a title, the first of the smallest year."""
    return F.try_element_at(F.array_sort(dates, lambda a, b: a["year"] - b["year"]), F.lit(1))
