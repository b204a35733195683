"""Queries of fields: value sets, prices, availability, colours, gaps, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellwerk.functions import fields as X
from quellwerk.functions import rules as Q
from quellwerk.operators import state as S
from quellwerk.plans.catalog import query
from quellwerk.session import table
from quellwerk.sources import tariff_text


@query(
    """SELECT satz_nr, list_sort(list_distinct(['grundpreis ' || replace(printf('%.2f', grundgebuehr), '.', ',') || ' €', 'im ersten jahr ' || laufzeit_monate || ' monate', 'mit ' || laufzeit_monate || ' gb'])) AS werte FROM tarife WHERE grundgebuehr IS NOT NULL AND laufzeit_monate IS NOT NULL"""
)
def a21_value_set(spark, sf):
    """Label, number and unit of every value of a page, units in one spelling."""
    t = table(spark, sf, "tarife").where("grundgebuehr is not null and laufzeit_monate is not null")
    n = F.col("laufzeit_monate").cast("string")
    page = F.concat(F.lit("Grundpreis  "), F.replace(F.format_string("%.2f", "grundgebuehr"), F.lit("."), F.lit(",")), F.lit(" Euro.\nim ersten Jahr "), n, F.lit(" Monate, mit "), n, F.lit(" GB; mit "), n, F.lit(" GB"))
    return t.select("satz_nr", tariff_text.values(page).alias("werte"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 != 3 THEN p_retailprice END AS preis, CASE p_size % 4 WHEN 0 THEN 'lieferbar' WHEN 1 THEN 'ausverkauft' WHEN 2 THEN 'unbekannt' END AS lage FROM (SELECT p_partkey, p_size, round(p_retailprice, 2) AS p_retailprice FROM part)")
def a39_prices(spark, sf):
    """Prices in both notations within their range, and availabilities."""
    two = F.format_string("%,.2f", F.round("p_retailprice", 2))
    german = F.translate(two, ",.", ".,")
    k = F.col("p_size") % 4
    text = F.when(k == 3, F.lit("12.345,00 €")).when(k == 0, F.concat(german, F.lit(" €"))).otherwise(two)
    lage = F.when(k == 0, "https://schema.org/InStock").when(k == 1, "SoldOut").when(k == 2, "http://x.example/Neu")
    return table(spark, sf, "part").select("p_partkey", X.price(text).alias("preis"), X.availability(lage).alias("lage"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'midnight black' WHEN 1 THEN 'blau' END AS farbe, CASE p_size % 2 WHEN 0 THEN 'erneuert' ELSE 'neu' END AS zustand FROM part")
def h15_colour_and_condition(spark, sf):
    """The longest colour of a title and its condition."""
    k = F.col("p_size")
    title = F.concat(F.lit("Modell X, "), F.when(k % 3 == 0, "Midnight Black").when(k % 3 == 1, "blau").otherwise("Blaubeere"), F.when(k % 2 == 0, F.lit(" (refurbished)")).otherwise(F.lit(" unused")))
    return table(spark, sf, "part").select("p_partkey", X.longest_word(title, X.COLOURS).alias("farbe"), X.condition(title).alias("zustand"))


@query(
    """SELECT satz_nr, list_sort(list_filter([CASE WHEN grundgebuehr IS NULL THEN 'grundgebuehr' END, CASE WHEN datenvolumen_gb IS NULL THEN 'volumen' END, CASE WHEN laufzeit_monate IS NULL THEN 'laufzeit' END, CASE WHEN anschlusspreis IS NULL THEN 'anschluss' END], lambda x: x IS NOT NULL)) AS luecken,
  grundgebuehr IS NOT NULL AND laufzeit_monate IS NOT NULL AND confidence IN ('hoch', 'mittel') AS verlaesslich FROM tarife"""
)
def d16_gaps(spark, sf):
    """What a price of a tariff lacks, and whether it is reliable."""
    t = table(spark, sf, "tarife")
    lacks = X.gaps(grundgebuehr=F.col("grundgebuehr"), volumen=F.col("datenvolumen_gb"), laufzeit=F.col("laufzeit_monate").cast("double"), anschluss=F.col("anschlusspreis"))
    sure = F.col("grundgebuehr").isNotNull() & F.col("laufzeit_monate").isNotNull() & F.col("confidence").isin("hoch", "mittel")
    return t.select("satz_nr", lacks.alias("luecken"), sure.alias("verlaesslich"))


@query("SELECT id, eingang_am, CASE WHEN length(trim(title)) <= 60 THEN trim(title) ELSE regexp_replace(left(trim(title), 60), '\\s+\\S*$', '') || '…' END AS kurz FROM items WHERE title IS NOT NULL AND NOT regexp_matches(trim(title), '[.!?]\\s')")
def h10_cut_titles(spark, sf):
    """Titles of one sentence in at most sixty characters, cut at a word's end."""
    i = table(spark, sf, "items").where(F.col("title").isNotNull() & ~F.trim("title").rlike(r"[.!?]\s"))
    return i.select("id", "eingang_am", Q.cut_text(F.trim("title"), 2, 60).alias("kurz"))


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS tag, count(*) AS n FROM events GROUP BY 1), w AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS tag, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS f FROM events)
SELECT event_id, f > 5 AS gesperrt, n > 280 AS tag_voll FROM w JOIN d USING (tag)"""
)
def i18_limits_and_quota(spark, sf):
    """More than five of a key in a day lock it; more than 280 of all on a calendar day fail the day's run."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("tag"))
    full = e.groupBy("tag").agg((F.count("*") > 280).alias("tag_voll"))
    return S.rate_limited(e, "user_id", "ts", 86400, 5).join(full, "tag").select("event_id", F.col("zuviel").alias("gesperrt"), "tag_voll")
