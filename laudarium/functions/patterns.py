"""Fixed patterns of edited historical documents, and the one way by which they reach Spark."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str) -> str:
    """A pattern for Spark: Unicode classes, line ends only at \\n. Nested brackets mean a union there and must be escaped."""
    if re.search(r"\[[^\]\\]*(?<!\\)\[", re.sub(r"\\.", "", pattern)):
        raise ValueError(f"escape the bracket within a class: {pattern}")
    return "(?dU)" + pattern


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(rx(p)) for p in patterns])


def number_of(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur; one that is listed twice counts twice."""
    return reduce(lambda a, b: a + b, [text.rlike(rx(p)).cast("int") for p in patterns])


def _anycase(patterns: list[str]) -> list[str]:
    return ["(?iu)" + p for p in patterns]


# Month words, as found in lower-case text.
MONTHS = "(stycze?[nń])|(luty?)|(marz?e?c)|(kwie[tc]i?e?[nń])|(maj)|(czerwi?e?c)|(lipi?e?c)|(sierpi?e?[nń])|(wrze[sś]i?e?[nń])|(październik)|(listopad)|(grudz?i?e?[nń])|([ji]anuar)|(februar)|(mart)|(april)|(mai)|([ji]u[nl]i)|(august)|(septemb)|(octob)|(decemb)"

# Beginnings of month words after i has become j, and the month; the first that occurs holds.
MONTH_CUES = [
    ("stycz", 1), ("janua", 1), ("lut", 2), ("febr", 2), ("mar", 3), ("kwjet", 4), ("apr", 4), ("maj", 5), ("czerw", 6), ("jun", 6), ("ljp", 7), ("jul", 7),
    ("sjerp", 8), ("aug", 8), ("wrze", 9), ("sept", 9), ("paźdz", 10), ("octob", 10), ("list", 11), ("nov", 11), ("grud", 12), ("dece", 12),
]

# Signs of an editor's note.
META_SIGNS = [
    r"\d ?[-—] ?\d",
    r"^.?.?Rp\.",
    r"(?iu) mowa o ",
    r"^[\WiIvVxX]{1,3} [^\\]{1,40}$",
    r"[0-9]-[0-9]",
    r"(?iu)(wsp[oöó0][lł)|(]czesn)|(De[oc]r\.)|(Vol\.)|(Vol.? leg)|(VL\.)|(Dr\.)|(Fasc\.)|([fF]ol\.)|(Hal\. Rel\.)|(Castr\. Hal\.)|(Hal\. Laud\.)|(Cop\. Castr\.)|(Lauda Dobrinensia)|(Monit\.? Comit\.? Pol\.?)|( z?ob\.)|( str\.)|(mowa tu)|(zachodzi tu)|(rkp\.)|(rękopis)|(jak to utrzymy)|(Lauda krakowskie)",
]

# Titles of resolutions, and of other documents.
RESOLUTION_TITLES = ["Artyk", "Articuli", "Postanowien", "Uchwał[ay]", "Deklarac", "Laudu?m?a?", "Konfedera", "Instru[kc]", r"Kwit\s", "Pokwitowan"]
OTHER_TITLES = [
    "Uniwersa[lł]", "Wezwanie", "Mandat", "Legac[yj]", "Deputac[yj]", "Pełnomocnic", "Poselstwo", "App?robac[yj]a", "Odpowiedź", "List", "Mowa", "Wotum", "Zdanie",
    "Pokazowan", "Okazowan", "Popis", "Manifest", "Protest", "Reprotest", "Reskrypt", "Uniwersał", "Actum", "Zjazd", "D[iy]ar[iy]usz", "Relac", "Zapisk", "Sejmik",
    "Zebranie", "Continuatio", "Limitatio", "Literae", "Zebrani", "Zaświadczenie", "Stwierdzenie", "Att?estac", "Zagajen", "Upomnien", "Szlachta", "Ziemian", "Sejmik",
    "Kasztel", "S[ąę]d", "Chor", "Podkomo", "Taxa",
]
NEAR_TITLES = ["[kK]ról [pP]ols", "^We? "]

# Signs of a heading, of the first and of the second order, and signs against one.
HEADING_FIRST = [r"^\[.*\]", *RESOLUTION_TITLES, *OTHER_TITLES]
HEADING_SECOND = [
    r"\d+",
    r"(pierwsz)|(drug)|(wt[oó]r)|(dwa)|(trz[ae][cd]z?)|(czwart)|(czter)|(pi[ąę][tc])|(sz[óe][śs][tć])|(si[eó]de?m)|([oó][sś]i?e?m)|(dziewi[ęą][tć])|(dzie[sś]i?[ęą][tcć])|(na[śs][tć])|(st[oa])|(setn?)|(tysi[ęą]c)|(prim)|(secund)|(terti)|(quart)|(quint)|(se[xg])|(vice)|(esim)|(cent)|(mille)|( [xXvViIl]{1,3} )|\d+|" + MONTHS,
    *_anycase(["przedsejmo", "konwokacyj", "deput", "zwołuj", "kwituj", "wyboru", "elekc[jy]", "wzywa", "ruszenia", "posłom", "skład", "zwołu"]),
    *_anycase(["sejmiku", "conventus", "palatinatu", "przedsejmo", "konwokacyj", "deput", "województwa", "ziemi", "księstw", "rycerstw", "szlachty", "ziemian"]),
]
HEADING_AGAINST = [
    r"\D0+",
    r"[ae]my[,\.\s]", r"[aeyi]ć[,\.\s]", r"[iyaeąę]ł[ay]?[,\.\s]", r"[iae\[iaeąę]\]li?[,\.\s]", r"[sś]my[,\.\s]", r"ąc[aey]?[mj]?u?[,\.\s]", r"[aoe]n[yieaą][jm]?[,\.\s]",
    *_anycase([
        r"\smy\s", "ichm", "jmp", "jkr", r"\smość", r"\smci", r"\span(a|u|(em))?\s", r"Dr\.?\s", r"\sby[lł]", "działo", "brak", "miasto", r"\saby\s", r"\siż\s", r"\sże\s", "początk", "pamięci",
        "panow", r"\stu(taj)?\s", "tzn", "tj", "według", "wedle", "obacz", r"\sakta\s", r"mowa tu\s", r"p[\.,] \d", "obtulit", "feria", "festum", "decretor", "poborca", "naprzód", "dokumentacja",
        "literatura", "wierzytelna", r" s\. ", "nieprawy", "działo s",
    ]),
]

# The formula that opens a resolution, and words of its first sentence.
OPENING = r"(?iu)^[^\w]{0,4}my.? r[au]d"
OPENING_WORDS = ["dygnitarze", "urzędnic", "rycerstw", "obywatel", "panow", "wszyst", "wszytk", "koronn", "świec", "duchown", "ziem"]

# What a scanner makes of some letters, and the repair, in the order in which they apply.
OCR_REPAIRS = [
    ("lnstru", "Instru"), ("rn ", "m "), ("ćm ", "em "), ("ćj ", "ej "), ("wv", "w"), ("^ ?@", "§"), ("^ ?%", "§"), ("^ ?&", "§"), ("^ ?ś ", "§ "), ("^ ?g ", "§ "), (" lmc", " Imc"), (" ct ", " et "),
]
