"""History of changing attributes as a bitemporal ledger.

Every ledger row says: from ``gueltig_von`` until ``gueltig_bis`` (exclusive,
null: open) the entity had these values, and the system believed so from
``erfasst_von`` until ``erfasst_bis`` (null: still).  A late reading splits
the interval it falls into; a second reading of a day replaces the first.
Neither overwrites: the rows they supersede stay, closed in recorded time.

Shapes that keep one entity from becoming one task:

* readings are first reduced per (entity, day), a hash aggregation with map-side
  combine, so an entity keeps at most one belief per day and change;
* the sweep sees the days of an entity once, an array that is bounded by the
  calendar, not by the data, and gives as many intervals as there are changes of
  neighbours; they meet the beliefs in an equi-join on (entity, day).

A ledger is a table like any other: ``applied`` takes a later batch into it and
touches the open rows of the batch's entities only.

Defined results: rows without entity, day or arrival are left out; a missing
value is a value of its own in the ledger and keeps the last known one in
``versions``; two readings of one day with the same arrival are ordered by the
tie column; repeated rows change nothing; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# German month names by their first three letters.
MONTHS = {"jan": 1, "feb": 2, "mär": 3, "mar": 3, "mrz": 3, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12}


def parse_day(text: Column) -> Column:
    """A date from ``2025-07-18``, ``2025-07-18T23:44:00Z`` (its first ten characters) or ``18.7.2025``; null else."""
    t = F.trim(text)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})(?:$|[T ])", 1)
    dmy = F.regexp_extract(t, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:$|[T ,])", 0)
    return F.coalesce(
        F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-M-d")).cast("date"),
        F.try_to_timestamp(F.nullif(F.regexp_extract(dmy, r"[\d.]+", 0), F.lit("")), F.lit("d.M.yyyy")).cast("date"),
    )


def parse_month(text: Column) -> Column:
    """Year * 12 + month - 1 of a version text in any of its spellings; null if it names none."""
    t = F.lower(F.trim(text))
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    word = F.regexp_extract(t, r"(?U)\b(jan|feb|mär|mar|mrz|apr|mai|may|jun|jul|aug|sep|okt|oct|nov|dez|dec)\w*\.?\s*\d{4}", 1)
    year = F.regexp_extract(t, r"(\d{4})\s*$", 1)
    ym = F.regexp_extract(t, r"(\d{4})-(\d{1,2})(?:-\d{1,2})?$", 1)
    ym_m = F.regexp_extract(t, r"(\d{4})-(\d{1,2})(?:-\d{1,2})?$", 2)
    my = r"(?:^|[^\d.])(?:\d{1,2}\.)?(\d{1,2})[./](\d{4}|\d{2})$"
    m, y = F.regexp_extract(t, my, 1), F.regexp_extract(t, my, 2)
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    full = F.when(F.length(y) == 2, number(y) + 2000).otherwise(number(y))
    month_of_word = F.try_element_at(names, F.nullif(word, F.lit("")))
    value = F.coalesce(
        number(ym) * 12 + number(ym_m) - 1,
        number(year) * 12 + month_of_word - 1,
        F.when(number(m).between(1, 12), full * 12 + number(m) - 1),
    )
    return F.when(F.coalesce(number(ym_m), number(m), F.lit(1)).between(1, 12), value)


def beliefs(readings: DataFrame, entity: str, day: str, recorded: str, values: list[str], tie: str) -> DataFrame:
    """What was believed of each (entity, day), and from when until when: entity, day, values, erfasst_von, erfasst_bis."""
    rows = readings.select(F.col(entity).alias("entity"), F.col(day).alias("day"), F.col(recorded).alias("rec"), F.struct(*values).alias("v"), F.col(tie).alias("tie"))
    rows = rows.where("entity is not null and day is not null and rec is not null")
    rows = rows.groupBy("entity", "day", "rec").agg(F.max_by("v", "tie").alias("v"))
    w = Window.partitionBy("entity", "day").orderBy("rec")
    changed = rows.withColumn("_before", F.lag(F.struct("v")).over(w)).where(~F.struct("v").eqNullSafe(F.col("_before"))).drop("_before")
    return changed.withColumn("until", F.lead("rec").over(w))


def neighbours(first: DataFrame) -> DataFrame:
    """entity, day, bis, von, ende: which known day followed a day (null: none), from and until when in recorded time (null: always, still).

    A sweep over the days of an entity from the last to the first keeps the later days that were the next one at some
    time: a day hides all later ones that became known after it, so days that arrive in order have one neighbour each.
    ``first``: entity, day, first (when the day became known); an entity has at most one row per calendar day.
    """
    kind = dict(first.dtypes)["first"]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for entity, days in zip(batch["entity"], batch["days"]):
                visible: list[tuple] = []  # nearest last; the farther, the earlier known
                for d in sorted(days, key=lambda x: x["day"], reverse=True):
                    ende = None
                    for bis, von in reversed(visible):
                        out.append((entity, d["day"], bis, von, ende))
                        ende = von
                    out.append((entity, d["day"], None, None, ende))
                    while visible and visible[-1][1] >= d["first"]:
                        visible.pop()
                    visible.append((d["day"], d["first"]))
            yield pd.DataFrame(out, columns=["entity", "day", "bis", "von", "ende"])

    days = first.groupBy("entity").agg(F.collect_list(F.struct("day", "first")).alias("days"))
    return days.mapInPandas(sweep, f"entity {dict(first.dtypes)['entity']}, day date, bis date, von {kind}, ende {kind}")


def ledger(readings: DataFrame, entity: str, day: str, recorded: str, values: list[str], tie: str) -> DataFrame:
    """The bitemporal ledger: entity, values, gueltig_von, gueltig_bis, erfasst_von, erfasst_bis."""
    known = beliefs(readings, entity, day, recorded, values, tie)
    next_ = neighbours(known.groupBy("entity", "day").agg(F.min("rec").alias("first")))
    # a belief holds while it is believed and while its neighbour is the next day: the intersection of both intervals
    met = known.join(next_, ["entity", "day"]).withColumn("a", F.greatest("rec", "von")).withColumn("b", F.least("until", "ende")).where("b is null or a < b")
    return met.select(F.col("entity").alias(entity), "v.*", F.col("day").alias("gueltig_von"), F.col("bis").alias("gueltig_bis"), F.col("a").alias("erfasst_von"), F.col("b").alias("erfasst_bis"))


def applied(book: DataFrame, readings: DataFrame, entity: str, day: str, recorded: str, values: list[str], tie: str) -> DataFrame:
    """The ledger after a batch of readings recorded later than everything in it.

    Only the open rows of the batch's entities are read and rewritten; closed rows and other entities stay as they
    are.  A batch that holds an older recorded time is refused, it would change what was believed in the past.
    """
    new = readings.where(F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(recorded).isNotNull())
    since = new.agg(F.min(recorded)).first()[0]
    if since is None:
        return book
    touched = new.select(entity).distinct()
    last = book.select(F.greatest("erfasst_von", "erfasst_bis").alias("t")).agg(F.max("t")).first()[0]
    if last is not None and last >= since:
        raise ValueError("the batch is older than the ledger")
    open_ = book.where("erfasst_bis is null").join(touched, entity, "left_semi")
    # the open rows are what was known before the batch, all at one moment before it
    before = F.lit(since) - F.expr("interval 1 microsecond")
    kind = dict(new.dtypes)
    held = open_.select(F.col(entity), F.col("gueltig_von").alias(day), before.cast(kind[recorded]).alias(recorded), *values, F.lit("0").cast(kind[tie]).alias(tie))
    again = ledger(held.unionByName(new.select(entity, day, recorded, *values, tie)), entity, day, recorded, values, tie)
    kept = open_.select(entity, "gueltig_von", F.col("erfasst_von").alias("_von"))
    again = again.join(kept, [entity, "gueltig_von"], "left")
    start = F.when(F.col("erfasst_von") < F.lit(since), F.col("_von")).otherwise(F.col("erfasst_von"))
    again = again.withColumn("erfasst_von", start).select(*book.columns)
    rest = book.where("erfasst_bis is not null").unionByName(book.where("erfasst_bis is null").join(touched, entity, "left_anti").select(*book.columns))
    return rest.unionByName(again)


def as_of(book: DataFrame, recorded, valid=None) -> DataFrame:
    """The rows believed at a recorded time, and of those the ones valid on a day if one is given."""
    r = F.lit(recorded)
    out = book.where((F.col("erfasst_von") <= r) & (F.col("erfasst_bis").isNull() | (F.col("erfasst_bis") > r)))
    if valid is None:
        return out
    v = F.lit(valid)
    return out.where((F.col("gueltig_von") <= v) & (F.col("gueltig_bis").isNull() | (F.col("gueltig_bis") > v)))


def current(book: DataFrame) -> DataFrame:
    """The rows believed now."""
    return book.where(F.col("erfasst_bis").isNull())


def versions(believed: DataFrame, entity: str, values: list[str]) -> DataFrame:
    """Longest runs of equal values; a missing value keeps the last known one.  One row per version.

    The window over an entity sees at most one row per calendar day.
    """
    w = Window.partitionBy(entity).orderBy("gueltig_von")
    kept = believed.select(entity, "gueltig_von", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])
    key = F.struct(*values)
    starts = kept.withColumn("_new", F.lag(key).over(w)).where(F.col("_new").isNull() | ~key.eqNullSafe(F.col("_new"))).drop("_new")
    return starts.withColumn("gueltig_bis", F.lead("gueltig_von").over(w))


def tariff_readings(tarife: DataFrame) -> DataFrame:
    """Readings with the day, the fee in cents and the version's month as numbers."""
    return tarife.select(
        "tarif_id",
        "satz_nr",
        "eingang_am",
        parse_day(F.col("abgerufen_am")).alias("tag"),
        F.when(~F.isnan("grundgebuehr"), F.round(F.col("grundgebuehr") * 100, 0)).cast("long").alias("cent"),
        parse_month(F.col("versionsstand")).alias("stand"),
    )


def tariff_ledger(tarife: DataFrame) -> DataFrame:
    return ledger(tariff_readings(tarife), "tarif_id", "tag", "eingang_am", ["cent", "stand"], "satz_nr")


def tariff_versions(tarife: DataFrame) -> DataFrame:
    """tarif_id, gueltig_von, gueltig_bis as yyyy-mm-dd; the last version's end is ''."""
    v = versions(current(tariff_ledger(tarife)), "tarif_id", ["cent", "stand"])
    return v.select("tarif_id", F.date_format("gueltig_von", "yyyy-MM-dd").alias("gueltig_von"), F.coalesce(F.date_format("gueltig_bis", "yyyy-MM-dd"), F.lit("")).alias("gueltig_bis"))


def tariff_ledger_in_steps(tarife: DataFrame, days: list[str]) -> DataFrame:
    """The ledger built from the readings before the first day, then batch by batch."""
    from quellwerk.session import materialise

    r = tariff_readings(tarife)
    arrived = F.to_date("eingang_am")
    names = ("tarif_id", "tag", "eingang_am", ["cent", "stand"], "satz_nr")
    book = ledger(r.where(arrived < F.lit(days[0])), *names)
    for a, b in zip(days, [*days[1:], "9999-12-31"]):
        book = materialise(applied(materialise(book, "ledger"), r.where((arrived >= F.lit(a)) & (arrived < F.lit(b))), *names), "ledger")
    return book
