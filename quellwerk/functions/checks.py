"""Predicates and validators on texts and fields: Column -> Column, inside code generation.

Null texts count as empty unless a function says otherwise.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from quellwerk.functions import text as T


def folded(text: Column) -> Column:
    """Lower case, white space collapsed; empty for null."""
    return F.trim(F.regexp_replace(T.low(F.coalesce(text, F.lit(""))), r"\s+", " "))


def quoted_in(quote: Column, text: Column, least: int = 8) -> Column:
    """Does the text hold the quote literally, white space and case aside? Shorter quotes prove nothing."""
    q = folded(quote)
    return (F.length(q) >= least) & F.contains(folded(text), q)


def all_numbers(text: Column) -> Column:
    """Sorted distinct numbers of a text with the decimal comma as a point, without zeros that say nothing."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:[.,]\d+)?)"), 1)
    point = F.transform(found, lambda n: F.regexp_replace(F.replace(n, F.lit(","), F.lit(".")), r"(\.\d*?)0+$", "$1"))
    return F.array_sort(F.array_distinct(F.transform(point, lambda n: F.regexp_replace(n, r"\.$", ""))))


def numbers_allowed(text: Column, allowed: Column) -> Column:
    """Is every number of the text among the allowed ones?"""
    return F.size(F.array_except(all_numbers(text), allowed)) == 0


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many different keywords begin a word of the text; Unicode letters count as word characters."""
    low = T.low(F.coalesce(text, F.lit("")))
    return sum((low.rlike(rf"(?:^|[^\p{{L}}\p{{N}}]){w}").cast("int") for w in words), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces of a text that end with a mark before white space, in order."""
    marked = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"([.!?])\s+", "$1\u0000")
    return F.filter(F.split(marked, "\u0000"), lambda s: F.trim(s) != "")


def without_sentences(text: Column, pattern: str) -> Column:
    """The text without the sentences a pattern matches."""
    return F.array_join(F.filter(sentences(text), lambda s: ~T.low(s).rlike(pattern)), " ")


def without_paragraphs(text: Column, pattern: str) -> Column:
    """The text without the paragraphs a pattern matches; paragraphs are parted by blank lines."""
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: ~T.low(p).rlike(pattern) & ~p.rlike(r"^[\s\p{Z}]*$")), "\n\n")


def headings(markdown: Column) -> Column:
    """Second-level headings of a text, in order."""
    return F.transform(F.regexp_extract_all(F.concat(F.lit("\n"), F.coalesce(markdown, F.lit(""))), F.lit(r"\n## +([^\n]+)"), 1), F.trim)


def briefing_faults(markdown: Column, required: tuple[str, ...], forbidden: tuple[str, ...], longest: int) -> Column:
    """Sorted names of the rules a text breaks: missing headings, forbidden phrases, no link, a paragraph too long."""
    low = T.low(F.coalesce(markdown, F.lit("")))
    missing = F.transform(F.array_except(F.array(*map(F.lit, required)), headings(markdown)), lambda h: F.concat(F.lit("fehlt:"), h))
    phrases = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(f"verboten:{p}")) for p in forbidden]))
    size = F.array_max(F.transform(F.split(F.coalesce(markdown, F.lit("")), r"\n\s*\n"), F.length))
    rest = F.array_compact(F.array(F.when(~low.rlike(r"\]\(https?://"), F.lit("kein_link")), F.when(size > longest, F.lit("absatz_zu_lang"))))
    return F.array_sort(F.concat(missing, phrases, rest))


def keyword_fault(term: Column) -> Column:
    """Why a keyword of a filter is refused: kurz (under four characters), lang (over sixty), leer (no letter); null if it is fine."""
    t = F.trim(F.coalesce(term, F.lit("")))
    return F.when(F.length(t) < 4, "kurz").when(F.length(t) > 60, "lang").when(~t.rlike(r"\p{L}"), "leer")


def unproven(evidence: Column, raw: Column) -> Column:
    """Sorted fields of map<field, evidence> whose evidence is missing, too long or not in the raw text."""
    bad = F.map_filter(evidence, lambda k, v: ~F.coalesce(F.contains(raw, v) & (F.length(v) <= 300) & (v != ""), F.lit(False)))
    return F.array_sort(F.map_keys(bad))


def tags(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """Sorted labels of which a text holds at least one word."""
    low = T.low(F.coalesce(text, F.lit("")))
    hit = lambda ws: F.lit(False) if not ws else F.greatest(*[F.contains(low, F.lit(w)) for w in ws], F.lit(False))
    return F.array_sort(F.array_compact(F.array(*[F.when(hit(ws), F.lit(k)) for k, ws in words.items()])))


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 as hex digits; null stays null.  The key is padded on the driver, rows stay in the JVM."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ p for b in k)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def mail_address(text: Column) -> Column:
    """The address in lower case without blanks; null if it is none."""
    t = F.lower(F.trim(text))
    return F.when((F.length(t) <= 254) & t.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"), t)


def signed_token(key: str, purpose: Column, data: Column, at: Column) -> Column:
    """purpose.data.seconds.signature; the data may not hold a point."""
    body = F.concat_ws(".", purpose, data, at.cast("string"))
    return F.concat_ws(".", body, F.substring(hmac_sha256(key, body), 1, 32))


def token_data(key: str, purpose: str, token: Column, now: Column, oldest: int, youngest: int = 0) -> Column:
    """The data of a token whose signature, purpose and age (seconds) hold; null else."""
    body, mark = F.substring_index(token, ".", 3), F.substring_index(token, ".", -1)
    parts = F.split(token, r"\.")
    age = now - F.try_element_at(parts, F.lit(3)).try_cast("bigint")
    good = (F.size(parts) == 4) & (F.element_at(parts, 1) == purpose) & (mark == F.substring(hmac_sha256(key, body), 1, 32)) & age.between(youngest, oldest)
    return F.when(good, F.try_element_at(parts, F.lit(2)))


def element_or_null(items: Column, index: Column) -> Column:
    """The element a (possibly wrong) index written as text names, counted from 0; null if there is none."""
    n = F.when(F.trim(index).rlike(r"^\d{1,9}$"), F.trim(index).cast("int"))
    return F.when((n >= 0) & (n < F.size(items)), F.get(items, n))


def axis_top(value: Column) -> Column:
    """The next of 1, 2, 5 times a power of ten that is not below the value; 1 for values up to 1 and null."""
    v = F.greatest(F.coalesce(value, F.lit(1.0)), F.lit(1.0))
    power = F.pow(F.lit(10.0), F.floor(F.log10(v) + 1e-12))
    return F.when(v <= power, power).when(v <= 2 * power, 2 * power).when(v <= 5 * power, 5 * power).otherwise(10 * power)


def projected(value: Column, low: Column, high: Column, length: float) -> Column:
    """Place of a value on an axis of some length; the middle if the axis has no extent."""
    return F.when(high == low, F.lit(length / 2)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)) * length)


def section(text: Column, mark: str) -> Column:
    """What stands after ===MARK=== up to the next mark; null if the mark is not there."""
    rest = F.regexp_extract(text, rf"(?s)==={mark}===(.*?)(?:===[A-ZÄÖÜ]+===|$)", 1)
    return F.when(F.contains(text, F.lit(f"==={mark}===")), F.trim(F.regexp_replace(rest, r"^\s+|\s+$", "")))


def day_label(day: Column) -> Column:
    """d.m.yyyy."""
    return F.concat_ws(".", F.dayofmonth(day), F.month(day), F.year(day))


# German month names.
GERMAN_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()


def month_label(day: Column) -> Column:
    """The German name of the month and the year; null for null."""
    return F.concat(F.element_at(F.array(*map(F.lit, GERMAN_MONTHS)), F.month(day)), F.lit(" "), F.year(day).cast("string"))
