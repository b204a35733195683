"""Queries on the history of tariffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.operators import history
from quellwerk.plans.catalog import query
from quellwerk.session import table

_READINGS = r"""
WITH months(w, m) AS (VALUES ('jan',1),('feb',2),('mär',3),('apr',4),('mai',5),('jun',6),('jul',7),('aug',8),('sep',9),('okt',10),('nov',11),('dez',12)),
raw AS (
  SELECT tarif_id, satz_nr, eingang_am, trim(abgerufen_am) AS a, lower(trim(versionsstand)) AS v, CAST(round(grundgebuehr * 100) AS BIGINT) AS cent FROM tarife),
day AS (
  SELECT *, CASE WHEN regexp_matches(a, '^\d{4}-\d{1,2}-\d{1,2}') THEN CAST(try_strptime(left(a, 10), '%Y-%m-%d') AS DATE)
                 WHEN regexp_matches(a, '^\d{1,2}\.\d{1,2}\.\d{4}$') THEN CAST(try_strptime(a, '%d.%m.%Y') AS DATE) END AS tag,
    CASE WHEN regexp_matches(v, '^\d{4}-\d{1,2}$') THEN CAST(left(v, 4) AS BIGINT) * 12 + CAST(substr(v, 6) AS BIGINT) - 1
         WHEN regexp_matches(v, '[a-zä]{3,}\.? \d{4}$') THEN CAST(right(v, 4) AS BIGINT) * 12 + (SELECT m FROM months WHERE w = left(regexp_extract(v, '([a-zä]{3,})\.? \d{4}$', 1), 3)) - 1
         WHEN regexp_matches(v, '\d{1,2}[./]\d{4}$') THEN CAST(right(v, 4) AS BIGINT) * 12 + CAST(regexp_extract(v, '(\d{1,2})[./]\d{4}$', 1) AS BIGINT) - 1
         WHEN regexp_matches(v, '^\d{1,2}[./]\d{2}$') THEN (2000 + CAST(right(v, 2) AS BIGINT)) * 12 + CAST(regexp_extract(v, '^(\d{1,2})', 1) AS BIGINT) - 1 END AS stand
  FROM raw),
held AS (SELECT * FROM day WHERE tarif_id IS NOT NULL AND tag IS NOT NULL AND eingang_am IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY tarif_id, tag ORDER BY eingang_am DESC, satz_nr DESC) = 1),
kept AS (SELECT tarif_id, tag,
    last_value(cent IGNORE NULLS) OVER w AS cent, last_value(stand IGNORE NULLS) OVER w AS stand
  FROM held WINDOW w AS (PARTITION BY tarif_id ORDER BY tag ROWS UNBOUNDED PRECEDING)),
starts AS (SELECT *, lag(tag) OVER (PARTITION BY tarif_id ORDER BY tag) AS p, lag(cent) OVER (PARTITION BY tarif_id ORDER BY tag) AS pc, lag(stand) OVER (PARTITION BY tarif_id ORDER BY tag) AS ps FROM kept),
versions AS (SELECT tarif_id, tag, cent, stand FROM starts WHERE p IS NULL OR cent IS DISTINCT FROM pc OR stand IS DISTINCT FROM ps)
"""


@query(
    _READINGS
    + """SELECT tarif_id, strftime(tag, '%Y-%m-%d') AS gueltig_von,
  coalesce(strftime(lead(tag) OVER (PARTITION BY tarif_id ORDER BY tag), '%Y-%m-%d'), '') AS gueltig_bis FROM versions"""
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of every tariff with the period of each."""
    return history.tariff_versions(table(spark, sf_dir, "tarife"))


_LEDGER = (
    _READINGS
    + """, r AS (SELECT tarif_id, tag, eingang_am AS rec, cent, stand FROM day WHERE tarif_id IS NOT NULL AND tag IS NOT NULL AND eingang_am IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tarif_id, tag, eingang_am ORDER BY satz_nr DESC) = 1),
b0 AS (SELECT *, row_number() OVER w AS nr, lag(cent) OVER w AS pc, lag(stand) OVER w AS ps FROM r WINDOW w AS (PARTITION BY tarif_id, tag ORDER BY rec)),
b AS (SELECT tarif_id, tag, rec, cent, stand, lead(rec) OVER (PARTITION BY tarif_id, tag ORDER BY rec) AS bis FROM b0 WHERE nr = 1 OR cent IS DISTINCT FROM pc OR stand IS DISTINCT FROM ps),
f AS (SELECT tarif_id, tag, min(rec) AS erst FROM b GROUP BY 1, 2),
t AS (SELECT tarif_id, tag, rec, rec AS z FROM b UNION SELECT b.tarif_id, b.tag, b.rec, f.erst FROM b JOIN f ON f.tarif_id = b.tarif_id AND f.tag > b.tag AND f.erst > b.rec AND (b.bis IS NULL OR f.erst < b.bis)),
n AS (SELECT t.tarif_id, t.tag, t.rec, t.z, min(f.tag) AS naechster FROM t LEFT JOIN f ON f.tarif_id = t.tarif_id AND f.tag > t.tag AND f.erst <= t.z GROUP BY 1, 2, 3, 4),
s0 AS (SELECT *, lag(naechster) OVER w AS pn, row_number() OVER w AS nr FROM n WINDOW w AS (PARTITION BY tarif_id, tag, rec ORDER BY z)), s1 AS (SELECT * FROM s0 WHERE nr = 1 OR naechster IS DISTINCT FROM pn)
SELECT b.tarif_id, b.cent, b.stand, b.tag AS gueltig_von, s1.naechster AS gueltig_bis, s1.z AS erfasst_von, coalesce(lead(s1.z) OVER (PARTITION BY s1.tarif_id, s1.tag, s1.rec ORDER BY s1.z), b.bis) AS erfasst_bis FROM s1 JOIN b USING (tarif_id, tag, rec)"""
)


@query(_LEDGER)
def p3_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bitemporal ledger of the tariffs."""
    return history.tariff_ledger(table(spark, sf_dir, "tarife"))


@query(_LEDGER)
def p3_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger, built from the readings of one year and three later batches applied to it."""
    return history.tariff_ledger_in_steps(table(spark, sf_dir, "tarife"), ["2026-01-01", "2026-04-01", "2026-07-01"])


@query(
    _READINGS
    + """, h AS (SELECT tarif_id, tag, cent, stand FROM day WHERE tarif_id IS NOT NULL AND tag IS NOT NULL AND eingang_am <= TIMESTAMP '2025-12-31 23:59:59' QUALIFY row_number() OVER (PARTITION BY tarif_id, tag ORDER BY eingang_am DESC, satz_nr DESC) = 1)
SELECT tarif_id, cent, stand, CAST(tag AS VARCHAR) AS von, CAST(lead(tag) OVER (PARTITION BY tarif_id ORDER BY tag) AS VARCHAR) AS bis FROM h"""
)
def p3_believed_midway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was believed at the end of 2025, before later readings arrived."""
    book = history.tariff_ledger(table(spark, sf_dir, "tarife"))
    return history.as_of(book, "2025-12-31 23:59:59").select("tarif_id", "cent", "stand", F.col("gueltig_von").cast("string").alias("von"), F.col("gueltig_bis").cast("string").alias("bis"))
