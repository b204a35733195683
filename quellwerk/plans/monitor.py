"""Queries of the monitoring run: nested records, change events, event studies, retries, pluggable models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.operators import models
from quellwerk.operators import relational as R
from quellwerk.operators import state as S
from quellwerk.plans.catalog import query
from quellwerk.session import scalar, table
from quellwerk.sources import documents as D


@query("SELECT region, source_name, id, title FROM items WHERE region IS NOT NULL AND source_name IS NOT NULL")
def b4_flatten_nested(spark, sf):
    """A nested report per region, exploded back to rows."""
    i = table(spark, sf, "items").where("region is not null and source_name is not null")
    # nested per source and day of arrival, as the reports are, so an array holds one run of one source
    nested = i.groupBy("region", "source_name", F.to_date("eingang_am").alias("tag")).agg(F.collect_list(F.struct("id", "title")).alias("meldungen"))
    return nested.select("region", "source_name", F.inline("meldungen"))


@query("SELECT satz_nr, von_monat, bis_monat, betrag FROM (SELECT satz_nr, unnest(preisphasen, recursive := true) FROM tarife)")
def a40_variants_flatten(spark, sf):
    """Rows of a nested list, through its JSON form."""
    t = table(spark, sf, "tarife").select("satz_nr", F.to_json("preisphasen").alias("j"))
    return t.select("satz_nr", F.inline(F.from_json("j", "array<struct<von_monat:int,bis_monat:int,betrag:double>>")))


@query(
    """WITH v AS (SELECT anbieter, CASE WHEN eingang_am < TIMESTAMP '2026-01-01' THEN 0 ELSE 1 END AS lauf, lower(name) || ' ' || printf('%.2f', grundgebuehr) || ' €' AS w FROM tarife WHERE name IS NOT NULL AND grundgebuehr IS NOT NULL),
d AS (SELECT anbieter, list_sort(list(DISTINCT w) FILTER (WHERE lauf = 1 AND w NOT IN (SELECT w FROM v y WHERE y.lauf = 0 AND y.anbieter = x.anbieter))) AS dazu, list_sort(list(DISTINCT w) FILTER (WHERE lauf = 0 AND w NOT IN (SELECT w FROM v y WHERE y.lauf = 1 AND y.anbieter = x.anbieter))) AS weg FROM v x WHERE anbieter IS NOT NULL GROUP BY anbieter)
SELECT anbieter, len(coalesce(dazu, [])) AS dazu, len(coalesce(weg, [])) AS weg FROM d WHERE len(coalesce(dazu, [])) + len(coalesce(weg, [])) > 0"""
)
def a20_page_changes(spark, sf):
    """Value sets of pages in two runs: what came and what went."""
    t = table(spark, sf, "tarife").where("anbieter is not null and name is not null and grundgebuehr is not null")
    w = t.select("anbieter", "eingang_am", F.concat(F.lower("name"), F.lit(" "), F.format_string("%.2f", "grundgebuehr"), F.lit(" €")).alias("w"))
    d = R.value_diff(w.where("eingang_am < timestamp'2026-01-01'"), w.where("eingang_am >= timestamp'2026-01-01'"), ["anbieter"], "w")
    return d.select("anbieter", F.size("dazu").cast("bigint").alias("dazu"), F.size("weg").cast("bigint").alias("weg"))


@query("SELECT name, kind != 'official' AS erlaubt FROM quellen")
def a43_robots(spark, sf):
    """Robots rules of every source, asked for one path each."""
    q = table(spark, sf, "quellen")
    rules = F.when(F.col("kind") == "official", F.lit("User-agent: *\nDisallow: /feed\n")).otherwise(F.lit("User-agent: *\nDisallow: /feed/alt\nAllow: /feed\n"))
    return q.select("name", D.allowed(rules, F.lit("/feed")).alias("erlaubt"))


@query("SELECT r.r_name AS region, count(n.n_nationkey) AS n FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey AND n.n_nationkey % 2 = 0 GROUP BY r.r_name")
def d21_zero_groups(spark, sf):
    """Groups without rows stay with zero."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation").where("n_nationkey % 2 = 0")
    return r.join(n, r.r_regionkey == n.n_regionkey, "left").groupBy(F.col("r_name").alias("region")).agg(F.count("n_nationkey").alias("n"))


@query(
    """SELECT user_id, event_id, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS stand FROM (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)"""
)
def e8_carry_forward(spark, sf):
    """A value that was not measured keeps the last one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return e.select("user_id", "event_id", F.last("v", ignorenulls=True).over(w).alias("stand"))


@query(
    """WITH s AS (SELECT user_id, min(ts) AS start FROM events WHERE event_type = 'signup' GROUP BY 1), d AS (SELECT user_id, t AS tage, start + t * INTERVAL 1 DAY AS z FROM s, (VALUES (0), (7), (14)) AS x(t)),
p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY 1, 2)
SELECT d.user_id, tage, p.value AS stand FROM d ASOF LEFT JOIN p ON d.user_id = p.user_id AND d.z >= p.ts"""
)
def e12_event_study(spark, sf):
    """The value as of a start and some days after it."""
    e = table(spark, sf, "events")
    start = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("start"))
    asked = start.select("user_id", F.explode(F.array(*map(F.lit, (0, 7, 14)))).alias("tage"), "start").withColumn("z", F.expr("start + make_dt_interval(tage)"))
    bought = e.where("event_type = 'purchase' and value is not null").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("value").alias("value"))
    return R.as_of(asked.select("user_id", "tage", "z"), bought, ["user_id"], "z", "at", "value", "stand").select("user_id", "tage", "stand")


@query("SELECT id, url, strftime(published, '%Y-%m') AS monat, row_number() OVER (PARTITION BY strftime(published, '%Y-%m') ORDER BY published DESC, id, url, eingang_am) AS platz FROM items WHERE published IS NOT NULL")
def e15_rank_in_month(spark, sf):
    """Place in the month, newest first: the place in the day plus the rows of later days, so no task sorts a month."""
    i = table(spark, sf, "items").where("published is not null").withColumn("monat", F.date_format("published", "yyyy-MM")).withColumn("tag", F.to_date("published"))
    days = i.groupBy("monat", "tag").agg(F.count("*").alias("n"))
    later = F.sum("n").over(Window.partitionBy("monat").orderBy(F.col("tag").desc()).rowsBetween(Window.unboundedPreceding, -1))
    w = Window.partitionBy("monat", "tag").orderBy(F.col("published").desc(), "id", "url", "eingang_am")
    j = i.withColumn("r", F.row_number().over(w)).join(days.select("monat", "tag", F.coalesce(later, F.lit(0)).alias("davor")), ["monat", "tag"])
    return j.select("id", "url", "monat", (F.col("r") + F.col("davor")).cast("bigint").alias("platz"))


@query(
    """SELECT source_name, id, bild FROM (SELECT source_name, id, image_url IS NOT NULL AS bild, row_number() OVER (PARTITION BY source_name ORDER BY CASE WHEN image_url IS NOT NULL THEN 0 ELSE 1 END, published DESC NULLS LAST, id, url, eingang_am) AS r FROM items) WHERE r = 1"""
)
def e18_lead_with_image(spark, sf):
    i = table(spark, sf, "items")
    order = [F.col("image_url").isNull().cast("int"), F.col("published").desc_nulls_last(), "id", "url", "eingang_am"]
    return R.latest(i, ["source_name"], order).select("source_name", "id", F.col("image_url").isNotNull().alias("bild"))


@query("SELECT name, kind, rang FROM (SELECT name, kind, CASE kind WHEN 'rss' THEN 1 WHEN 'json_api' THEN 2 WHEN 'newsroom' THEN 3 ELSE 9 END AS rang FROM quellen)")
def f8_status_rank(spark, sf):
    rank = F.when(F.col("kind") == "rss", 1).when(F.col("kind") == "json_api", 2).when(F.col("kind") == "newsroom", 3).otherwise(9)
    return table(spark, sf, "quellen").select("name", "kind", rank.alias("rang")).orderBy("rang", "name")


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_retailprice > 1000 EXCEPT SELECT p_brand, p_type FROM part WHERE p_retailprice <= 1000")
def g2_names_except_known(spark, sf):
    p = table(spark, sf, "part")
    return p.where("p_retailprice > 1000").select("p_brand", "p_type").subtract(p.where("p_retailprice <= 1000").select("p_brand", "p_type"))


@query("SELECT DISTINCT image_url FROM items WHERE image_url IS NOT NULL AND source_name NOT IN (SELECT name FROM quellen WHERE kind = 'rss')")
def g6_unreferenced_images(spark, sf):
    """Images no configured feed refers to."""
    i = table(spark, sf, "items").where("image_url is not null and source_name is not null")
    keep = table(spark, sf, "quellen").where("kind = 'rss'").select(F.col("name").alias("source_name"))
    return i.join(keep, "source_name", "left_anti").select("image_url").distinct()


@query(
    """WITH h AS (SELECT DISTINCT l_suppkey AS s, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT b, count(*) AS wer FROM h GROUP BY b), k AS (SELECT count(DISTINCT s) AS alle FROM h)
SELECT s.s_suppkey AS s, count(*) FILTER (WHERE h.s IS NULL) AS luecken FROM supplier s CROSS JOIN n LEFT JOIN h ON h.s = s.s_suppkey AND h.b = n.b GROUP BY 1"""
)
def g8_gaps_per_competitor(spark, sf):
    """How many of all brands a supplier does not have, without pairing suppliers and brands."""
    l, p = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), table(spark, sf, "part").select("p_partkey", "p_brand")
    have = l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("s"), "p_brand").distinct()
    total = F.lit(scalar(have.agg(F.count_distinct("p_brand"))))
    n = have.groupBy("s").agg(F.count("*").alias("n"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"))
    return s.join(n, "s", "left").select("s", (total - F.coalesce("n", F.lit(0))).alias("luecken"))


@query(r"SELECT satz_nr, regexp_extract_all(lower(regexp_replace(regexp_replace(replace(name, '+', ' plus '), '([a-zäöü])([A-ZÄÖÜ])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g')), '[a-z0-9äöüß]+') AS marken FROM tarife WHERE name IS NOT NULL")
def h14_token_stream(spark, sf):
    """Tokens with letters and digits, camel case and plus signs taken apart."""
    t = F.replace("name", F.lit("+"), F.lit(" plus "))
    t = F.regexp_replace(F.regexp_replace(t, "([a-zäöü])([A-ZÄÖÜ])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    return table(spark, sf, "tarife").where("name is not null").select("satz_nr", F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9äöüß]+)"), 1).alias("marken"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\r?\n[ \t]*\r?\n'), lambda x: regexp_matches(x, '[^ ]'))) AS absaetze, CAST(ceil(length(text) / 600.0) AS BIGINT) AS stuecke FROM documents WHERE text IS NOT NULL AND text != ''")
def h31_paragraphs(spark, sf):
    d = table(spark, sf, "documents").where("text is not null and text != ''")
    n = F.size(F.filter(F.split("text", r"\r?\n[ \t]*\r?\n"), lambda x: x.rlike("[^ ]"))).cast("bigint")
    return d.select("doc_id", n.alias("absaetze"), F.ceil(F.length("text") / 600.0).alias("stuecke"))


@query("SELECT i.id, i.url FROM items i WHERE i.id NOT IN (SELECT lower(item_id) FROM uebersetzungen WHERE item_id IS NOT NULL AND modell IS NOT NULL AND modell != '')")
def i2_retry_unread(spark, sf):
    """Only what was processed to the end counts as seen, the rest comes again."""
    done = table(spark, sf, "uebersetzungen").where("modell is not null and modell != ''").select(F.lower("item_id").alias("id")).where("id is not null").distinct()
    return table(spark, sf, "items").select("id", "url").join(done, "id", "left_anti")


@query(
    """WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS alt, min(o_orderdate) AS zuerst FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_totalprice) AS neu, max(o_orderdate) AS zuletzt FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(neu, alt) AS preis, coalesce(zuerst, zuletzt) AS zuerst, n.k IS NULL AS verpasst FROM o FULL JOIN n ON o.k = n.k"""
)
def i6_stateful_upsert(spark, sf):
    """A new run against the state: known values survive a missing one, the missing are marked."""
    o = table(spark, sf, "orders")
    old = o.where("o_orderdate < timestamp'1998-01-01'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("alt"), F.min("o_orderdate").alias("zuerst"))
    new = o.where("o_orderdate >= timestamp'1998-01-01'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("neu"), F.max("o_orderdate").alias("zuletzt"))
    return old.join(new, "k", "full_outer").select("k", F.coalesce("neu", "alt").alias("preis"), F.coalesce("zuerst", "zuletzt").alias("zuerst"), F.col("neu").isNull().alias("verpasst"))


@query("SELECT a.tarif_id, a.satz_nr FROM tarife a WHERE a.dokument_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tarife b WHERE b.dokument_hash = a.dokument_hash AND (b.eingang_am, b.satz_nr) < (a.eingang_am, a.satz_nr))")
def i12_cache_misses(spark, sf):
    """Only the first reading of every content is computed, later ones hit the cache."""
    t = table(spark, sf, "tarife").where("dokument_hash is not null")
    return R.latest(t, ["dokument_hash"], ["eingang_am", "satz_nr"]).select("tarif_id", "satz_nr")


@query("SELECT user_id, max(ts) AS stand, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') > 3 AS abgelaufen FROM events WHERE event_type = 'error' GROUP BY user_id")
def i25_negative_cache(spark, sf):
    g = table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("stand"))
    return g.select("user_id", "stand", (F.date_diff(F.lit("2024-01-31").cast("date"), F.to_date("stand")) > 3).alias("abgelaufen"))


@query("SELECT id, url, CASE WHEN length(title) > 60 THEN NULL ELSE upper(left(title, 5)) END AS antwort, CASE WHEN length(title) > 60 THEN 'fehler' ELSE 'ok' END AS stand FROM items WHERE title IS NOT NULL")
def j1_model_udf(spark, sf):
    """A pluggable batch model with a failure policy per row; here a stand-in that refuses long titles."""

    def answer(texts: list[str]) -> list[str]:
        if any(len(t) > 60 for t in texts):
            raise ValueError("too long")
        return [t[:5].upper() for t in texts]

    i = table(spark, sf, "items").where("title is not null").select("id", "url", "title")
    return models.apply(i, "title", answer, "antwort", "stand").drop("title")


@query("SELECT region, count(*) AS n, max(published) AS juengste, CAST(sum(length(title)) AS BIGINT) AS zeichen FROM items WHERE region IS NOT NULL GROUP BY region")
def j3_partial_and_final(spark, sf):
    """Two-stage summary: partial per source, final per region."""
    part = table(spark, sf, "items").where("region is not null").groupBy("region", "source_name").agg(F.count("*").alias("n"), F.max("published").alias("p"), F.sum(F.length("title")).alias("z"))
    return part.groupBy("region").agg(F.sum("n").alias("n"), F.max("p").alias("juengste"), F.sum("z").alias("zeichen"))


@query("SELECT id, url, eingang_am FROM items WHERE contains(lower(replace(title, 'İ', 'i')), 'prices') AND NOT regexp_matches(lower(replace(title, 'İ', 'i')), '(^|[^a-z])cuts($|[^a-z])')")
def h8_word_boundaries(spark, sf):
    t = T.low(F.col("title"))
    return table(spark, sf, "items").where(F.contains(t, F.lit("prices")) & ~t.rlike(r"(?<![a-z])cuts(?![a-z])")).select("id", "url", "eingang_am")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderstatus != 'F'")
def c5_representative_anti(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus != 'F'").select("o_orderkey", F.col("o_custkey"))
    bad = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(bad, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT a.p_partkey, b.p_partkey AS nachfolger FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND b.p_size = a.p_size + 1")
def c17_successors(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", (F.col("p_size") + 1).alias("p_size"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("nachfolger"), "p_brand", "p_name", "p_size")
    return a.join(b, ["p_brand", "p_name", "p_size"]).select("p_partkey", "nachfolger")


_ = S
