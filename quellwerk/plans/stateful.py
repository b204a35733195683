"""Queries of the stateful operators, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellwerk.operators import relational as R
from quellwerk.operators import state as S
from quellwerk.plans.catalog import query
from quellwerk.session import table
from quellwerk.streaming import jobs


@query(
    """WITH o AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT event_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fehlserie FROM o"""
)
def i5_quarantine_streaks(spark, sf):
    return S.failure_streaks(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "fehlserie")


@query(
    """SELECT event_id, coalesce(last_value(CASE WHEN value >= 68 THEN true WHEN value < 60 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS drin FROM events"""
)
def i11_hysteresis(spark, sf):
    return S.hysteresis(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 68, 60).select("event_id", "drin")


@query(
    """WITH l AS (SELECT event_id, user_id, event_type, ts, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS vorher FROM events WHERE value IS NOT NULL)
SELECT event_id, vorher, value FROM l WHERE vorher IS NULL OR vorher != value"""
)
def i9_change_points(spark, sf):
    return S.change_points(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value").select("event_id", "vorher", "value")


@query("SELECT user_id, max(day(ts)) AS zuletzt, CAST(least(greatest(30 - max(day(ts)), 0), 2) AS INTEGER) AS stufe FROM events GROUP BY user_id")
def i7_two_step_ageing(spark, sf):
    return S.ageing(table(spark, sf, "events").withColumn("tag", F.dayofmonth("ts").cast("bigint")), "user_id", "tag", 30)


@query(
    """SELECT event_id, count(*) OVER w AS im_fenster, count(*) OVER w > 2 AS zuviel FROM (SELECT event_id, user_id, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW)"""
)
def i18_sliding_limit(spark, sf):
    return S.rate_limited(table(spark, sf, "events"), "user_id", "ts", 600, 2).select("event_id", "im_fenster", "zuviel")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 14400000000 THEN 0 ELSE 1 END AS neu FROM events), s AS (SELECT user_id, ts, sum(neu) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, min(ts) AS beginn, max(ts) AS ende FROM s GROUP BY user_id, k"""
)
def i16_sessions(spark, sf):
    return S.sessions(table(spark, sf, "events"), "user_id", "ts", 240)


@query(
    """WITH plan AS (SELECT c_custkey, c_mktsegment FROM customer), log AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT c_custkey, c_mktsegment FROM plan WHERE c_custkey NOT IN (SELECT o_custkey FROM log WHERE r = 1 AND o_orderpriority != '5-LOW')"""
)
def i17_idempotent_plan(spark, sf):
    o = table(spark, sf, "orders")
    sent = R.latest(o, ["o_custkey"], ["o_orderkey"]).where("o_orderpriority != '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(sent, "c_custkey", "left_anti")


@query(
    """WITH s AS (SELECT tarif_id, satz_nr, name, confidence, dokument_hash, row_number() OVER (PARTITION BY tarif_id ORDER BY eingang_am, satz_nr) AS a, row_number() OVER (PARTITION BY tarif_id ORDER BY eingang_am DESC, satz_nr DESC) AS z FROM tarife),
p AS (SELECT x.tarif_id, x.name AS n0, y.name AS n1, x.confidence AS c0, y.confidence AS c1, x.dokument_hash AS h0, y.dokument_hash AS h1 FROM s x JOIN s y ON x.tarif_id = y.tarif_id AND x.a = 1 AND y.z = 1)
SELECT tarif_id, 'name' AS feld, n0 AS alt, n1 AS neu FROM p WHERE n1 IS NOT NULL AND n0 IS DISTINCT FROM n1 UNION ALL SELECT tarif_id, 'confidence', c0, c1 FROM p WHERE c1 IS NOT NULL AND c0 IS DISTINCT FROM c1
UNION ALL SELECT tarif_id, 'dokument_hash', h0, h1 FROM p WHERE h1 IS NOT NULL AND h0 IS DISTINCT FROM h1"""
)
def i14_field_diff(spark, sf):
    t = table(spark, sf, "tarife")
    first = R.latest(t, ["tarif_id"], ["eingang_am", "satz_nr"])
    last = R.latest(t, ["tarif_id"], [F.col("eingang_am").desc(), F.col("satz_nr").desc()])
    return R.field_diff(first, last, "tarif_id", ["name", "confidence", "dokument_hash"])


@query(
    """SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 AS hart, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS weich, max(ts) AS stand FROM events GROUP BY user_id"""
)
def i19_event_fold(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id")
    return g.agg((F.max((F.col("event_type") == "error").cast("int")) == 1).alias("hart"), F.sum((F.col("event_type") == "view").cast("int")).alias("weich"), F.max("ts").alias("stand"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def i15_bounded_history(spark, sf):
    return R.top_per_group(table(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 20).select("user_id", "event_id")


def _stream(spark, sf):
    static = table(spark, sf, "events")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("SELECT event_id, user_id FROM events")
def i1_stream_dedupe(spark, sf):
    """Every event once, by a watermarked stream."""
    s = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_to_end(jobs.novel(s, "event_id", "ts", "60 days").select("event_id", "user_id"), "novel")


@query(
    """WITH o AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
s AS (SELECT user_id, event_id, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM o)
SELECT user_id, CAST(f AS INTEGER) AS fehlserie, f >= 3 AS quarantaene FROM s WHERE r = 1"""
)
def i5_stream_quarantine(spark, sf):
    """The streaks as a stream with state per user."""
    s = _stream(spark, sf).select("user_id", F.col("event_id").alias("n"), (F.col("event_type") == "error").alias("bad"))
    return jobs.run_to_end(jobs.streaks(s, "user_id", "bad", 3), "streaks", "update")


@query(
    """SELECT user_id, event_id AS n, alt, value AS neu FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS alt FROM events WHERE value IS NOT NULL) WHERE alt IS DISTINCT FROM value"""
)
def i9_stream_changes(spark, sf):
    """Change points as a stream with the last value per user as state."""
    s = _stream(spark, sf).select("user_id", F.col("event_id").alias("n"), "value")
    return jobs.run_to_end(jobs.changes(s, "user_id", "value"), "changes")
