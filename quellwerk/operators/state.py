"""State over runs as batch plans: streaks, hysteresis, ageing, limits, change points, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_streaks(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """fehlserie: failures in a row up to and including each row; a success resets it."""
    w = Window.partitionBy(key).orderBy(*order)
    out = rows.withColumn("_ok", F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(key, "_ok").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("fehlserie", F.sum(failed.cast("int")).over(island)).drop("_ok")


def hysteresis(rows: DataFrame, key: str, order: list[str], value: str, enter: float, leave: float) -> DataFrame:
    """drin: on from the first value >= enter until the first < leave; in between the last state holds, at first off."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    edge = F.when(F.col(value) >= enter, F.lit(True)).when(F.col(value) < leave, F.lit(False))
    return rows.withColumn("drin", F.coalesce(F.last(edge, ignorenulls=True).over(w), F.lit(False)))


def change_points(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows where the value differs from the last measured one; a null is not measured and keeps it."""
    w = Window.partitionBy(*key).orderBy(*order)
    kept = rows.where(F.col(value).isNotNull()).withColumn("vorher", F.lag(value).over(w))
    return kept.where(F.col("vorher").isNull() | (F.col("vorher") != F.col(value)))


def ageing(seen: DataFrame, key: str, period: str, last: int) -> DataFrame:
    """stufe of every key at period ``last``: 0 active, 1 supposed gone after one missed period, 2 delisted after two."""
    s = seen.groupBy(key).agg(F.max(period).alias("zuletzt"))
    return s.select(key, "zuletzt", F.least(F.greatest(F.lit(last) - F.col("zuletzt"), F.lit(0)), F.lit(2)).cast("int").alias("stufe"))


def rate_limited(rows: DataFrame, key: str, when: str, seconds: int, most: int) -> DataFrame:
    """im_fenster: rows of the key in the last so many seconds, this one counted; zuviel: more than allowed."""
    at = F.unix_micros(F.col(when).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("im_fenster", F.count("*").over(w)).withColumn("zuviel", F.col("im_fenster") > most)


def sessions(rows: DataFrame, key: str, when: str, gap_minutes: int) -> DataFrame:
    """key, beginn, ende, n of every run of rows whose gaps stay below so many minutes."""
    s = rows.groupBy(key, F.session_window(F.col(when).cast("timestamp"), f"{gap_minutes} minutes").alias("s"))
    return s.agg(F.count("*").alias("n"), F.min(when).alias("beginn"), F.max(when).alias("ende")).drop("s")


def merge_latest(old: DataFrame, new: DataFrame, key: str, when: str, rank: Column) -> DataFrame:
    """Per key the later row wins, at the same moment the higher rank."""
    from quellwerk.operators.relational import latest

    both = old.unionByName(new).withColumn("_rank", rank)
    return latest(both, [key], [F.col(when).desc_nulls_last(), F.col("_rank").desc(), *[c for c in old.columns if c not in (key, when)]]).drop("_rank")
