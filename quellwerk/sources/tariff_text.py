"""Fields of a tariff sheet's text as columns: every value with the line that proves it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellwerk.functions.text import german_decimal

# Number words in notice periods.
NUMBER_WORDS = {"einen": 1, "ein": 1, "eine": 1, "zwei": 2, "drei": 3, "sechs": 6, "zwölf": 12, "vierundzwanzig": 24}


def _line(text: Column, pattern: str) -> Column:
    """The first line that matches, at most 300 characters."""
    return F.substring(F.try_element_at(F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(pattern)), F.lit(1)), 1, 300)


def extract(sheets: DataFrame, text: str) -> DataFrame:
    """Adds laufzeit_monate, grundgebuehr, datenvolumen_gb, download_mbit and the proving line of each (beleg_*); absent fields are null."""
    t = F.col(text)
    term = r"(?i)(?:mindest)?(?:vertrags)?laufzeit[^\d\n]{0,40}"
    word = F.lower(F.regexp_extract(t, term + r"(\d+|" + "|".join(NUMBER_WORDS) + r")\s*Monat", 1))
    as_number = F.create_map(*[x for kv in NUMBER_WORDS.items() for x in map(F.lit, kv)])
    months = F.coalesce(word.try_cast("int"), F.try_element_at(as_number, F.nullif(word, F.lit(""))))
    fee = german_decimal(F.nullif(F.regexp_extract(t, r"(?i)(?:grundgebühr|monatlicher preis|grundpreis)[^\d\n]{0,40}(\d+(?:\.\d{3})*(?:,\d+)?)\s*(?:€|euro)", 1), F.lit("")))
    flat = t.rlike(r"(?i)(?:unbegrenzt|unlimited)[^\n]{0,40}(?:daten|volumen)|(?:daten|volumen)[^\n]{0,40}(?:unbegrenzt|unlimited)")
    volume = F.regexp_extract(t, r"(?i)datenvolumen[^\d\n]{0,40}(\d+(?:,\d+)?)\s*(GB|MB|TB)", 1)
    unit = F.upper(F.regexp_extract(t, r"(?i)datenvolumen[^\d\n]{0,40}(\d+(?:,\d+)?)\s*(GB|MB|TB)", 2))
    gb = german_decimal(F.nullif(volume, F.lit(""))) * F.when(unit == "TB", 1000.0).when(unit == "MB", 0.001).otherwise(1.0)
    rate = r"(?i)download[^\d\n]{0,60}(\d+(?:,\d+)?)\s*(G|M|K)bit"
    scale = F.upper(F.regexp_extract(t, rate, 2))
    down = german_decimal(F.nullif(F.regexp_extract(t, rate, 1), F.lit(""))) * F.when(scale == "G", 1000.0).when(scale == "K", 0.001).otherwise(1.0)
    return sheets.select(
        "*",
        months.alias("laufzeit_monate"),
        _line(t, r"(?i)laufzeit").alias("beleg_laufzeit"),
        fee.alias("grundgebuehr"),
        _line(t, r"(?i)grundgebühr|monatlicher preis|grundpreis").alias("beleg_preis"),
        F.when(flat, F.lit(float("inf"))).otherwise(gb).alias("datenvolumen_gb"),
        down.alias("download_mbit"),
    )


def values(text: Column) -> Column:
    """Sorted set of label:number+unit in a page's text, the words before a number (at most four) as its label."""
    found = F.regexp_extract_all(text, F.lit(r"((?:[A-Za-zÄÖÜäöüß]+\s+){0,4}\d+(?:[.,]\d+)?\s*(?:€|Euro|GB|MB|Mbit/s|Monate))"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"\s*Euro", " €"), r"\s+", " ")))))
