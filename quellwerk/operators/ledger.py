"""State kept over runs: snapshots, subscriptions, deliveries, budgets, merge on write.

Tables of state are parquet folders; a write never changes a version that is
there, so a run that is repeated or loses executors gives the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.session import new_folder


def changed(state: DataFrame, now: DataFrame, key: str, value: str, legacy: str | None = None) -> DataFrame:
    """key, stand: 'neu' (unknown key), 'gleich' or 'anders' for every row of ``now``; a key may be known under its legacy name only."""
    held = state.groupBy(key).agg(F.max(value).alias("_v"))
    out = now.join(held, key, "left")
    known = F.col("_v")
    if legacy:
        out = out.join(held.select(F.col(key).alias(legacy), F.col("_v").alias("_l")), legacy, "left")
        known = F.coalesce(known, F.col("_l"))
    return out.select(key, F.when(known.isNull(), "neu").when(known.eqNullSafe(F.col(value)), "gleich").otherwise("anders").alias("stand"))


def fold_states(events: DataFrame, key: str, order: list[str], rules: dict[str, str], final: tuple[str, ...]) -> DataFrame:
    """key, stand, seit: the state after all events; ``rules`` maps an event to its state, the first final state holds for ever."""
    state = F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("art"))
    told = events.withColumn("_s", state).where("_s is not null").withColumn("_o", F.struct(*order))
    end = F.when(F.col("_s").isin(*final), F.col("_o"))
    g = told.groupBy(key).agg(F.min(end).alias("_e"), F.min_by("_s", end).alias("_f"), F.max("_o").alias("_m"), F.max_by("_s", "_o").alias("_l"))
    return g.select(key, F.coalesce("_f", "_l").alias("stand"), F.coalesce(F.col("_e"), F.col("_m"))[order[0]].alias("seit"))


def bounded(rows: DataFrame, ready: Column, sure: Column, order: list[Column], most: int) -> DataFrame:
    """The rows with ``grund``: 'dran' for the first ``most`` ready ones, sure ones before the others; 'warten' and 'nichts zu tun' for the rest."""
    fit = rows.where(ready)
    chosen = fit.orderBy(F.when(sure, 0).otherwise(1), *order).limit(most).withColumn("_dran", F.lit(True))
    cols = rows.columns
    left = fit.join(chosen, [fit[c].eqNullSafe(chosen[c]) for c in cols], "left_anti")
    return chosen.select(*cols, F.lit("dran").alias("grund")).union(left.select(*cols, F.lit("warten"))).union(rows.where(~F.coalesce(ready, F.lit(False))).select(*cols, F.lit("nichts zu tun")))


def deliveries(ledger: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """The rows of a plan that no ledger row settles: sent and refused ones are done, failed ones may be tried again."""
    done = ledger.where(F.col("stand").isin("gesendet", "abgewiesen")).select(key).distinct()
    return plan.join(done, key, "left_anti")


class Merged:
    """A keyed table on the shared folder: rows are merged on write into a new version, the pointer is the last step."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_folder(spark, "merged")
        self.version = 0

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/v={self.version}") if self.version else None

    def write(self, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
        """Add rows; per key the last in the order stays.  A repeated write changes nothing."""
        held = self.read()
        both = rows if held is None else held.unionByName(rows)
        cols = both.columns
        merged = both.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select("r.*")
        merged.write.option("compression", "zstd").parquet(f"{self.path}/v={self.version + 1}")
        self.version += 1
        return self.read()
