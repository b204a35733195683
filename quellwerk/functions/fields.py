"""Fields of products and tariffs read from text and numbers: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quellwerk.functions import text as T

# Schema.org availabilities and what they mean here.
AVAILABILITY = {"instock": "lieferbar", "limitedavailability": "lieferbar", "onlineonly": "lieferbar", "preorder": "vorbestellbar", "backorder": "vorbestellbar", "outofstock": "ausverkauft", "soldout": "ausverkauft", "discontinued": "ausgelistet"}
COLOURS = ("midnight black", "black", "schwarz", "weiß", "white", "blau", "blue", "titan blau", "grün", "rot")
CONDITIONS = {"refurbished": "erneuert", "generalüberholt": "erneuert", "gebraucht": "gebraucht", "used": "gebraucht"}


def price(text: Column, low: float = 0.0, high: float = 10_000.0) -> Column:
    """A price in either notation above ``low`` and up to ``high``; null else."""
    p = T.german_decimal(text)
    return F.when((p > low) & (p <= high), p)


def availability(value: Column) -> Column:
    """What a schema.org availability, with or without its address, means; unbekannt for others, null for null."""
    name = F.lower(F.regexp_replace(value, r"^.*/", ""))
    table = F.create_map(*[F.lit(x) for kv in AVAILABILITY.items() for x in kv])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(table, name), F.lit("unbekannt")))


def longest_word(text: Column, words: tuple[str, ...]) -> Column:
    """The longest of the phrases a text holds as whole words, the first in the alphabet among equals."""
    low = F.concat(F.lit(" "), F.regexp_replace(T.low(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    hits = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.concat(F.lit(" "), w, F.lit(" "))))
    return F.array_min(F.transform(hits, lambda w: F.struct(-F.length(w), w.alias("w"))))["w"]


def condition(text: Column) -> Column:
    """neu, unless a word says otherwise."""
    word = longest_word(text, tuple(CONDITIONS))
    table = F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, word), F.lit("neu"))


def gaps(**fields: Column) -> Column:
    """Sorted names of the fields that are missing (null or not a number)."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c.isNull() | F.isnan(c), F.lit(name)) for name, c in fields.items()])))
