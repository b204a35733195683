"""Text functions: Column -> Column, all inside code generation."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# How German umlauts are spelled out.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


def low(text: Column) -> Column:
    """Lower case; the Turkish dotted capital becomes a plain i instead of two code points."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def fold(text: Column) -> Column:
    """Lower case, German umlauts spelled out."""
    out = F.lower(text)
    for a, b in UMLAUTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(text: Column) -> Column:
    """Words of a-z and digits joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of a-z, umlauts and digits with at least so many letters."""
    return F.array_distinct(F.filter(F.split(low(text), r"[^a-z0-9äöüß]+"), lambda w: F.length(w) >= least))


def words(text: Column, least: int = 1) -> Column:
    """All lower-case words in order, with repeats."""
    return F.filter(F.split(low(text), r"[^a-z0-9äöüß]+"), lambda w: F.length(w) >= least)


def stem(word: Column) -> Column:
    """The word without one of the endings en, es, er, s, if four letters remain."""
    return F.regexp_replace(word, r"^(.{4,}?)(?:en|es|er|s)$", "$1")


def numbers(text: Column) -> Column:
    """Distinct numbers of a text, with a decimal comma as a point, years 1900-2100 left out."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("."))), lambda n: ~n.rlike(r"^(19\d\d|20\d\d|2100)$"))))


def german_decimal(text: Column) -> Column:
    """1.234,56 or 1,234.56 or 1234 as a double; null if it is no number."""
    t = F.regexp_replace(text, r"[\s\u00a0\u200b€]", "")
    german = F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), ",", ".")
    english = F.replace(t, F.lit(","), F.lit(""))
    return F.when(t.rlike(r"^\d{1,3}(\.\d{3})*(,\d+)?$|^\d+,\d+$"), german).when(t.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$|^\d+(\.\d+)?$"), english).try_cast("double")


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, cut at a word's end, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def first_sentence(text: Column) -> Column:
    """Up to the first sentence mark followed by a space or the end."""
    s = F.regexp_extract(text, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.when(s != "", s).otherwise(text)


def reading_minutes(text: Column) -> Column:
    """Words / 200, rounded half to even, at least 1."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.bround(n / F.lit(200.0), 0).cast("int"))


def visible(html: Column) -> Column:
    """Text of a page: boilerplate elements and tags dropped, the five entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|noscript)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[\s\u00a0]+", " "))


def json_block(text: Column) -> Column:
    """The first JSON object in free text, with or without a fence; null if there is none."""
    return F.pandas_udf(lambda s: s.map(first_object), "string", F.PandasUDFType.SCALAR)(text)


def first_object(text: str | None) -> str | None:
    """The first complete JSON object of a text as it stands there."""
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, end = json.JSONDecoder().raw_decode(text, at)
        except ValueError:
            value = None
        if isinstance(value, dict):
            return text[at:end]
        at = text.find("{", at + 1)
    return None
