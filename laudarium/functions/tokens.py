"""The string form of tagged tokens, [LA_][PN_][??_|!!_]form:lemma:tag1:tag2, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import rx

#: Flag and its sign, in the order in which signs are written.
SIGNS = {"latin": "LA", "proper_name": "PN", "unknown_form": "??", "corrected": "!!"}


def decoded(token: Column) -> Column:
    """STRUCT<form, lemma, interp, flags>; null for what is no token (no colon outside the signs) and for null.

    A sign counts wherever a whole piece between underscores equals it; other underscores stay in the form.
    """
    pieces = F.split(token, "_")
    rest = F.array_join(F.filter(pieces, lambda p: ~p.isin(*SIGNS.values())), "_")
    fields = F.split(rest, ":")
    flags = [F.array_contains(pieces, sign).alias(name) for name, sign in SIGNS.items()]
    interp = F.slice(fields, F.lit(3), F.greatest(F.size(fields) - 2, F.lit(0)))
    return F.when(F.size(fields) >= 2, F.struct(F.get(fields, F.lit(0)).alias("form"), F.get(fields, F.lit(1)).alias("lemma"), interp.alias("interp"), *flags))


def encoded(form: Column, lemma: Column, interp: Column, latin: Column, proper_name: Column, unknown_form: Column, corrected: Column) -> Column:
    """Null form or lemma are empty strings, null flags false; of unknown and corrected only the first is written."""
    sign = lambda flag, s: F.when(flag, s + "_").otherwise("")
    doubt = F.when(unknown_form, "??_").when(corrected, "!!_").otherwise("")
    text = F.concat_ws(":", F.coalesce(form, F.lit("")), F.coalesce(lemma, F.lit("")), interp)
    return F.concat(sign(latin, "LA"), sign(proper_name, "PN"), doubt, text)


def token_list(text: Column) -> Column:
    """The readable tokens of a paragraph in order."""
    return F.filter(F.transform(F.filter(F.split(text, rx(r"\s")), lambda t: t != ""), decoded), lambda t: t.isNotNull())


def interp_str(interp: Column) -> Column:
    return F.array_join(interp, ":")


def forms_text(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["form"]), " ")


def stringified(value: Column) -> Column:
    """Null, false and the empty string are empty; 0 stays 0."""
    text = value.cast("string")
    return F.when(text.isNull() | (text == "false"), "").otherwise(text)
