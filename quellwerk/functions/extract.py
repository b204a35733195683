"""Values found in free text: delivery times, days, storage sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


# Units of a delivery time by the beginning of their word, in days; words that make a sentence one about delivery or about something else.
UNIT_DAYS = {"werktag": 1, "arbeitstag": 1, "tag": 1, "woche": 7}
ABOUT_DELIVERY = ("liefer", "versand", "versend", "zustell")
ABOUT_OTHER = ("laufzeit", "widerruf", "rückgabe", "kündig", "garantie", "gültig")
LEAD_IN = ("in", "binnen", "innerhalb")
BETWEEN = ("-", "–", "bis")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once a row: a lambda's variable is no copy of the expression, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def delivery_days(text: Column) -> Column:
    """struct<lage, von, bis>: days until delivery named in a text; weeks count seven days; null if it names none.

    Each sentence is read as tokens: a number before a unit is a time, with a second number before a separator a span.
    It counts if the sentence is about delivery, or a word like "in" leads to it, and about nothing else that takes time.
    """
    begins = lambda word, stems: F.exists(F.array(*map(F.lit, stems)), lambda s: word.startswith(s))

    def times(tokens: Column) -> Column:
        at = lambda i: F.coalesce(F.get(tokens, i), F.lit(""))
        number = lambda i: F.when(at(i).rlike(r"^\d{1,3}$"), at(i).cast("int"))
        days = lambda i: F.coalesce(*[F.when(at(i).startswith(u), F.lit(n)) for u, n in UNIT_DAYS.items()])

        def read(i: Column) -> Column:
            first = F.when(at(i - 2).isin(*BETWEEN), number(i - 3))
            led = at(F.when(first.isNull(), i - 2).otherwise(i - 4)).isin(*LEAD_IN)
            return F.struct((F.coalesce(first, number(i - 1)) * days(i)).alias("von"), (number(i - 1) * days(i)).alias("bis"), led.alias("led"))

        about, other = F.exists(tokens, lambda w: begins(w, ABOUT_DELIVERY)), F.exists(tokens, lambda w: begins(w, ABOUT_OTHER))
        # only a unit after a number is read
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: days(i).isNotNull() & number(i - 1).isNotNull())
        led = F.filter(F.transform(places, read), lambda x: x["bis"].isNotNull())
        return bound(F.struct(about.alias("about"), other.alias("other")), lambda s: F.filter(led, lambda x: ~s["other"] & (s["about"] | x["led"])))

    def state(low: Column, hit: Column) -> Column:
        stands = lambda lead: F.exists(F.array(*map(F.lit, ("verfügbar", "lieferbar"))), lambda w: F.contains(low, F.concat(F.lit(lead), w)))
        gone, now = stands("nicht ") | F.contains(low, F.lit("ausverkauft")), stands("sofort ") | (hit["bis"] <= 3)
        return F.when(gone, "nicht").when(now, "sofort").when(hit.isNotNull(), "wartezeit")

    def read_all(low: Column) -> Column:
        # sentences without a number before a unit, whatever stands between, name no time
        sentences = F.filter(F.split(low, r"[.!?;\n]+"), lambda s: s.rlike(rf"\d[^\d\p{{L}}–-]*(?:{'|'.join(UNIT_DAYS)})"))
        found = F.flatten(F.transform(sentences, lambda s: bound(F.regexp_extract_all(s, F.lit(r"(\d+|\p{L}+|[-–])"), 1), times)))
        return bound(F.try_element_at(found, F.lit(1)), lambda hit: F.struct(state(low, hit).alias("lage"), hit["von"].alias("von"), hit["bis"].alias("bis")))

    return bound(bound(F.lower(text), read_all), lambda x: F.when(x["lage"].isNotNull(), x))


def first_day(text: Column) -> Column:
    """The first d.m.yyyy or ISO day of a text that exists in the calendar."""
    dmy, iso = F.regexp_extract(text, r"(\d{1,2}\.\d{1,2}\.\d{4})", 1), F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(dmy, F.lit("")), F.lit("d.M.yyyy")), F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd"))).cast("date")


def storage_gb(text: Column) -> Column:
    """The only storage size of a title in GB, a number before RAM left out; null if there are several or none."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"(\d+\s*[GT]B(?!\s*RAM))"), 1)
    gb = F.array_distinct(F.transform(found, lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int") * F.when(F.contains(x, F.lit("T")), 1024).otherwise(1)))
    return F.when(F.size(gb) == 1, F.element_at(gb, 1))


def sections(markdown: Column) -> Column:
    """map<heading, body> of a text's second-level headings; a repeated heading keeps its last body."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), markdown), r"\n## "), lambda x: F.contains(x, F.lit("\n")))
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "\n", 1)).alias("k"), F.regexp_replace(F.regexp_replace(x, r"^[^\n]*\n", ""), r"^\s+|\s+$", "").alias("v")))
    named = F.filter(pairs, lambda p: p["k"] != "")
    return F.map_from_arrays(F.array_distinct(F.transform(named, lambda p: p["k"])), F.transform(F.array_distinct(F.transform(named, lambda p: p["k"])), lambda k: F.element_at(F.filter(named, lambda p: p["k"] == k), -1)["v"]))
