"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.functions import urls as U
from quellwerk.plans.catalog import query
from quellwerk.session import table

_PARTS = r"""
WITH u AS (SELECT {key}, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://', '') AS r, url FROM {t}),
p AS (SELECT {key}, url, regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^www\.', '') AS host,
  regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_filter(string_split(regexp_extract(r, '\?(.*)$', 1), '&'), lambda x: x != '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid|mc_[^=]*|ref|source)(=|$)')) AS q FROM u),
n AS (SELECT {key}, url, host, path, 'https://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS kanon FROM p)
"""


@query(_PARTS.format(key="zeilen_nr", t="uebersetzungen") + "SELECT zeilen_nr, kanon FROM n")
def h1_url_canonical(spark, sf):
    return table(spark, sf, "uebersetzungen").select("zeilen_nr", U.normalize(F.col("url")).alias("kanon"))


@query(_PARTS.format(key="zeilen_nr", t="uebersetzungen") + "SELECT zeilen_nr, host || path AS host_pfad, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain FROM n")
def h2_url_host_path(spark, sf):
    return table(spark, sf, "uebersetzungen").select("zeilen_nr", U.host_path(F.col("url")).alias("host_pfad"), U.registrable(F.col("url")).alias("domain"))


@query(_PARTS.format(key="zeilen_nr", t="uebersetzungen") + "SELECT zeilen_nr, left(sha256(kanon), 16) AS item FROM n")
def h17_item_id_hash(spark, sf):
    return table(spark, sf, "uebersetzungen").select("zeilen_nr", U.item_id(F.col("url")).alias("item"))


@query(
    r"""SELECT tarif_id, satz_nr, trim(regexp_replace(replace(replace(replace(replace(lower(name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM tarife"""
)
def h3_slugs(spark, sf):
    return table(spark, sf, "tarife").select("tarif_id", "satz_nr", T.slug(F.col("name")).alias("slug"))


@query(
    r"""WITH s AS (SELECT DISTINCT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM tarife),
r AS (SELECT name, slug, row_number() OVER (PARTITION BY slug ORDER BY name) AS n FROM s)
SELECT name, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS eindeutig FROM r"""
)
def h4_unique_slugs(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "tarife").select("name").distinct().withColumn("slug", F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("name"))
    return s.withColumn("n", n).select("name", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("n").cast("string"))).alias("eindeutig"))


@query(
    r"""SELECT id, url, list_sort(list_distinct(list_filter(string_split_regex(lower(replace(title, 'İ', 'i')), '[^a-z0-9äöüß]+'), lambda w: length(w) >= 3))) AS woerter FROM items"""
)
def h5_tokens(spark, sf):
    return table(spark, sf, "items").select("id", "url", F.array_sort(T.tokens(F.col("title"))).alias("woerter"))


@query(
    r"""SELECT id, url, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(title, '(\d+(?:[.,]\d+)?)', 1), lambda n: replace(n, ',', '.')), lambda n: NOT regexp_matches(n, '^(19\d\d|20\d\d|2100)$')))) AS zahlen FROM items"""
)
def h6_salient_numbers(spark, sf):
    return table(spark, sf, "items").select("id", "url", T.numbers(F.col("title")).alias("zahlen"))


@query(
    r"""SELECT id, url, CASE WHEN length(summary) <= 60 THEN summary ELSE regexp_replace(left(summary, 60), '\s+\S*$', '') || '…' END AS kurz,
  CASE WHEN regexp_extract(summary, '^(.*?[.!?])(?:\s|$)', 1) != '' THEN regexp_extract(summary, '^(.*?[.!?])(?:\s|$)', 1) ELSE summary END AS satz FROM items"""
)
def h10_truncation(spark, sf):
    return table(spark, sf, "items").select("id", "url", T.truncated(F.col("summary"), 60).alias("kurz"), T.first_sentence(F.col("summary")).alias("satz"))


@query(
    r"""WITH s AS (SELECT satz_nr, printf('%.2f', grundgebuehr) AS en, replace(printf('%.2f', grundgebuehr), '.', ',') AS de FROM tarife)
SELECT satz_nr, CAST(en AS DOUBLE) AS aus_en, CAST(replace(de, ',', '.') AS DOUBLE) AS aus_de FROM s WHERE en IS NOT NULL"""
)
def h13_decimals(spark, sf):
    t = table(spark, sf, "tarife").where("grundgebuehr is not null")
    en = F.format_string("%.2f", "grundgebuehr")
    return t.select("satz_nr", T.german_decimal(en).alias("aus_en"), T.german_decimal(F.replace(en, F.lit("."), F.lit(","))).alias("aus_de"))


@query("SELECT satz_nr, concat_ws('--', tarif_id, abgerufen_am) AS schluessel, left(sha1(concat_ws('|', tarif_id, name)), 12) AS abdruck FROM tarife")
def h16_surrogate_keys(spark, sf):
    return table(spark, sf, "tarife").select("satz_nr", F.concat_ws("--", "tarif_id", "abgerufen_am").alias("schluessel"), F.substring(F.sha1(F.concat_ws("|", "tarif_id", "name")), 1, 12).alias("abdruck"))


@query(
    r"""SELECT doc_id, greatest(1, CAST(round_even(len(list_filter(string_split_regex(text, '\s+'), lambda w: w != '')) / 200.0, 0) AS INTEGER)) AS minuten FROM documents WHERE text IS NOT NULL"""
)
def h27_reading_minutes(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.reading_minutes(F.col("text")).alias("minuten"))


@query(r"""SELECT props, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def h30_json_from_text(spark, sf):
    fenced = F.concat(F.lit("Antwort:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, sf, "events").select("props", "event_id", F.get_json_object(T.json_block(fenced), "$.k").cast("int").alias("k"))


@query(
    r"""WITH d AS (SELECT zeilen_nr, regexp_extract(url, '/(20\d\d)/(0[1-9]|1[0-2])(?:/(0[1-9]|[12]\d|3[01]))?(?:/|$)', ['y','m','d']) AS g FROM uebersetzungen WHERE url IS NOT NULL)
SELECT zeilen_nr, CASE WHEN g.y != '' THEN g.y || '-' || g.m || '-' || CASE WHEN g.d = '' THEN '01' ELSE g.d END END AS tag FROM d"""
)
def a7_date_from_url(spark, sf):
    return table(spark, sf, "uebersetzungen").where("url is not null").select("zeilen_nr", U.path_date(F.col("url")).cast("string").alias("tag"))


@query(
    r"""SELECT c_custkey, CAST(round_even((a * 0.5 + b * 0.3 + c * 0.2) / 3.0 * 100, 0) AS INTEGER) AS punkte FROM (
SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 3 WHEN c_acctbal >= 5000 THEN 2 WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS a,
  least(c_nationkey % 4, 3) AS b, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 2 ELSE 0 END AS c FROM customer)"""
)
def h22_composite_score(spark, sf):
    from quellwerk.operators.scoring import composite

    a = F.when(F.col("c_acctbal") >= 7500, 3).when(F.col("c_acctbal") >= 5000, 2).when(F.col("c_acctbal") >= 0, 1).otherwise(0)
    c = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 2).otherwise(0)
    axes = {"a": a, "b": F.least(F.col("c_nationkey") % 4, F.lit(3)), "c": c}
    return table(spark, sf, "customer").select("c_custkey", composite(axes, {"a": 0.5, "b": 0.3, "c": 0.2}).alias("punkte"))
