"""More queries: extraction, matching, lifecycles, ranked views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quellwerk.functions import extract as X
from quellwerk.operators import relational as R
from quellwerk.operators import similarity as M
from quellwerk.plans.catalog import query
from quellwerk.session import scalar, table


@query("SELECT event_id, CASE WHEN e % 4 = 0 THEN 'nicht' WHEN e % 4 = 1 OR (e % 4 = 2 AND d <= 3) OR (e % 4 = 3 AND d * 7 <= 3) THEN 'sofort' ELSE 'wartezeit' END AS lage, CASE WHEN e % 4 = 2 THEN d WHEN e % 4 = 3 THEN d * 7 END AS bis FROM (SELECT event_id, event_id AS e, CAST(event_id % 20 + 1 AS INTEGER) AS d FROM events)")
def a27_delivery_times(spark, sf):
    """Delivery times of sentences made from the events."""
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 4).alias("e"), (F.col("event_id") % 20 + 1).cast("string").alias("d"))
    text = F.when(F.col("e") == 0, "Derzeit nicht verfügbar").when(F.col("e") == 1, "Sofort lieferbar").when(F.col("e") == 2, F.concat(F.lit("Lieferung in "), "d", F.lit(" Werktagen"))).otherwise(F.concat(F.lit("Lieferzeit 1-"), "d", F.lit(" Wochen")))
    x = e.select("event_id", X.delivery_days(text).alias("x"))
    return x.select("event_id", "x.lage", F.col("x.bis").alias("bis"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS tag FROM orders")
def h20_day_in_text(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Auftrag vom "), F.date_format("o_orderdate", "d.M.yyyy"), F.lit(", sonst nichts")).alias("t"))
    return o.select("o_orderkey", X.first_day(F.col("t")).cast("string").alias("tag"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 1024 WHEN p_size % 3 = 1 THEN p_size END AS gb FROM part")
def h15_storage_from_title(spark, sf):
    p = table(spark, sf, "part")
    s = F.col("p_size").cast("string")
    title = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" "), s, F.lit(" TB"))).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" 8 GB RAM "), s, F.lit("GB"))).otherwise(F.concat("p_name", F.lit(" 900GB / 901GB")))
    return p.select("p_partkey", X.storage_gb(title).alias("gb"))


@query("SELECT n_nationkey, n_name AS lage, 'Text ' || n_regionkey AS folgen FROM nation")
def h32_sections(spark, sf):
    n = table(spark, sf, "nation")
    md = F.concat(F.lit("# Kopf\n\n## Lage\n"), "n_name", F.lit("\n\n## Folgen\nText "), F.col("n_regionkey").cast("string"))
    m = n.select("n_nationkey", X.sections(md).alias("m"))
    return m.select("n_nationkey", F.try_element_at("m", F.lit("Lage")).alias("lage"), F.try_element_at("m", F.lit("Folgen")).alias("folgen"))


@query()
def c19_greedy_matching(spark, sf):
    """Parts of one brand matched one to one to parts of the same brand and next size by the words the two share, best pairs first."""
    p = table(spark, sf, "part").withColumn("w", F.array_distinct(F.split("p_name", " ")))
    offers = p.where("p_size <= 25").select(F.concat_ws("|", "p_brand", "p_size").alias("k"), F.col("p_partkey").alias("angebot"), "w")
    images = p.where("p_size > 25").select(F.concat_ws("|", "p_brand", (F.col("p_size") - 25).cast("string")).alias("k"), F.col("p_partkey").alias("bild"), F.col("w").alias("v"))
    return R.match_by_words(offers, images, "k").select("k", "angebot", "bild", (F.col("n") + F.lit(0.5)).alias("punkte"))


@query(
    """WITH w AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(replace(min(title), 'İ', 'i')), '[^a-z0-9äöüß]+'), lambda x: length(x) >= 4)) AS ws FROM items WHERE title IS NOT NULL GROUP BY id),
t AS (SELECT * FROM (VALUES ('preise', ['prices', 'percent']), ('masten', ['masts', 'antennes', 'antenas']), ('auktion', ['spectrum', 'subasta', 'veiling'])) AS x(thema, schluessel))
SELECT thema, count(*) AS n FROM w, t WHERE len(list_intersect(ws, schluessel)) >= 1 GROUP BY thema"""
)
def c24_topic_containment(spark, sf):
    from quellwerk.functions import text as T

    topics = [("preise", "prices"), ("preise", "percent"), ("masten", "masts"), ("masten", "antennes"), ("masten", "antenas"), ("auktion", "spectrum"), ("auktion", "subasta"), ("auktion", "veiling")]
    t = spark.createDataFrame(topics, "thema string, wort string")
    i = table(spark, sf, "items").where("title is not null").groupBy("id").agg(F.min("title").alias("title"))
    w = i.select("id", F.explode(T.tokens(F.col("title"), 4)).alias("wort"))
    return w.join(F.broadcast(t), "wort").select("thema", "id").distinct().groupBy("thema").agg(F.count("*").alias("n"))


@query(
    """SELECT q.name, coalesce(n, 0) AS n, coalesce(n, 0) = 0 OR coalesce(juengste, TIMESTAMP '1970-01-01') < TIMESTAMP '2026-06-01' AS faellig FROM quellen q LEFT JOIN (SELECT source_name, count(*) AS n, max(published) AS juengste FROM items GROUP BY 1) i ON q.name = i.source_name"""
)
def c23_source_eligibility(spark, sf):
    i = table(spark, sf, "items").groupBy(F.col("source_name").alias("name")).agg(F.count("*").alias("n"), F.max("published").alias("juengste"))
    q = table(spark, sf, "quellen").select("name").join(i, "name", "left")
    n = F.coalesce("n", F.lit(0))
    return q.select("name", n.alias("n"), ((n == 0) | (F.coalesce("juengste", F.lit("1970-01-01").cast("timestamp_ntz")) < F.lit("2026-06-01").cast("timestamp_ntz"))).alias("faellig"))


@query("SELECT tarif_id, count(DISTINCT CAST(eingang_am AS DATE)) AS tage, min(grundgebuehr) AS von, max(grundgebuehr) AS bis, count(DISTINCT CAST(eingang_am AS DATE)) >= 4 AND date_diff('day', CAST(min(eingang_am) AS DATE), CAST(max(eingang_am) AS DATE)) >= 21 AS belastbar FROM tarife GROUP BY tarif_id")
def d13_lifecycle(spark, sf):
    day = F.to_date("eingang_am")
    g = table(spark, sf, "tarife").groupBy("tarif_id").agg(F.count_distinct(day).alias("tage"), F.min("grundgebuehr").alias("von"), F.max("grundgebuehr").alias("bis"), F.min(day).alias("a"), F.max(day).alias("z"))
    return g.select("tarif_id", "tage", "von", "bis", ((F.col("tage") >= 4) & (F.date_diff("z", "a") >= 21)).alias("belastbar"))


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS tag, count(*) FILTER (WHERE event_type = 'signup') AS neu, count(*) FILTER (WHERE event_type = 'error') AS fehler, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS betroffen, round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'click'), 0), 4) AS quote FROM events GROUP BY 1"""
)
def d24_daily_counters(spark, sf):
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("int"))
    g = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("tag"))
    return g.agg(n("signup").alias("neu"), n("error").alias("fehler"), F.count_distinct(F.when(F.col("event_type") == "error", F.col("user_id"))).alias("betroffen"), F.round(F.try_divide(n("purchase"), n("click")), 4).alias("quote"))


@query(
    """SELECT anbieter, tarif_id, grundgebuehr, row_number() OVER (PARTITION BY anbieter ORDER BY grundgebuehr NULLS LAST, tarif_id) AS platz FROM (SELECT *, row_number() OVER (PARTITION BY tarif_id ORDER BY eingang_am DESC, satz_nr DESC) AS r FROM tarife) WHERE r = 1"""
)
def d27_tariff_mart(spark, sf):
    last = R.latest(table(spark, sf, "tarife"), ["tarif_id"], [F.col("eingang_am").desc(), F.col("satz_nr").desc()])
    w = Window.partitionBy("anbieter").orderBy(F.col("grundgebuehr").asc_nulls_last(), "tarif_id")
    return last.select("anbieter", "tarif_id", "grundgebuehr", F.row_number().over(w).cast("bigint").alias("platz"))


@query("SELECT id, url, date_diff('day', CAST(published AS DATE), (SELECT max(CAST(published AS DATE)) FROM items)) AS alter_tage FROM items WHERE date_diff('day', CAST(published AS DATE), (SELECT max(CAST(published AS DATE)) FROM items)) BETWEEN 0 AND 14")
def e10_anchored_window(spark, sf):
    """The last fortnight before the newest row."""
    i = table(spark, sf, "items").withColumn("d", F.to_date("published"))
    age = F.date_diff(F.lit(scalar(i.agg(F.max("d")))), F.col("d"))
    return i.where(age.between(0, 14)).select("id", "url", age.cast("bigint").alias("alter_tage"))


@query("SELECT region, id, url, r AS rang FROM (SELECT region, id, url, row_number() OVER (PARTITION BY region ORDER BY published DESC NULLS LAST, id, url, eingang_am) AS r FROM items WHERE region IS NOT NULL) WHERE r <= 5 ORDER BY r, region LIMIT 20")
def e2_budgeted_round_robin(spark, sf):
    """A report of twenty rows, regions in turn."""
    i = table(spark, sf, "items").where("region is not null")
    top = R.top_per_group(i, ["region"], [F.col("published").desc_nulls_last(), "id", "url", "eingang_am"], 5)
    return top.orderBy("rang", "region").limit(20).select("region", "id", "url", F.col("rang").cast("bigint").alias("rang"))


@query(
    """WITH g AS (SELECT id, min(title) AS title, min(published) AS p FROM items WHERE title IS NOT NULL GROUP BY id), t AS (SELECT id, p, list_distinct(list_filter(string_split_regex(lower(replace(title, 'İ', 'i')), '[^a-z0-9äöüß]+'), lambda x: length(x) >= 4)) AS ws FROM g),
e AS (SELECT id, unnest(ws) AS wort FROM t), d AS (SELECT wort FROM e GROUP BY wort HAVING count(*) BETWEEN 2 AND 50), c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM e a JOIN d USING (wort) JOIN e b USING (wort) WHERE a.id < b.id),
o AS (SELECT c.a, c.b FROM c JOIN t x ON x.id = c.a JOIN t y ON y.id = c.b WHERE len(list_intersect(x.ws, y.ws)) / least(len(x.ws), len(y.ws)) >= 0.8 AND (x.p IS NULL OR y.p IS NULL OR abs(epoch_us(x.p) - epoch_us(y.p)) <= 259200000000))
SELECT k AS id, count(*) AS partner FROM (SELECT a AS k FROM o UNION ALL SELECT b FROM o) GROUP BY k"""
)
def c27_evidence_counts(spark, sf):
    """How many reports of the same event every report has."""
    from quellwerk.functions import text as T

    i = table(spark, sf, "items").where("title is not null").groupBy("id").agg(F.min("title").alias("title"), F.min("published").alias("p"))
    pairs = M.overlap_pairs(i, "id", T.tokens(F.col("title"), 4), "p", 72, 0.8, 2, 50)
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("partner"))


@query("SELECT o_custkey AS k, min(o_orderdate) AS zuerst, max(o_orderdate) AS zuletzt, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS stand FROM orders GROUP BY 1")
def i8_slowly_changing(spark, sf):
    """First seen, last seen and the last state of every key."""
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"))
    return g.agg(F.min("o_orderdate").alias("zuerst"), F.max("o_orderdate").alias("zuletzt"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("stand"))


@query("SELECT user_id, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 THEN 'ja' WHEN count(DISTINCT CAST(ts AS DATE)) >= 3 THEN 'nein' ELSE 'unbekannt' END AS stand FROM events GROUP BY user_id")
def i10_tri_state(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("j"), F.count_distinct(F.to_date("ts")).alias("n"))
    return g.select("user_id", F.when(F.col("j") == 1, "ja").when(F.col("n") >= 3, "nein").otherwise("unbekannt").alias("stand"))


@query("SELECT satz_nr, list_filter([CASE WHEN grundgebuehr IS NULL THEN 'ohne_preis' END, CASE WHEN versionsstand IS NULL OR versionsstand = '' THEN 'ohne_stand' END, CASE WHEN isinf(datenvolumen_gb) THEN 'unbegrenzt' END, CASE WHEN confidence = 'niedrig' THEN 'unsicher' END], lambda x: x IS NOT NULL) AS merkmale FROM tarife")
def h25_quality_flags(spark, sf):
    flags = F.array(
        F.when(F.col("grundgebuehr").isNull(), "ohne_preis"), F.when(F.col("versionsstand").isNull() | (F.col("versionsstand") == ""), "ohne_stand"),
        F.when(F.col("datenvolumen_gb") == float("inf"), "unbegrenzt"), F.when(F.col("confidence") == "niedrig", "unsicher"),
    )
    return table(spark, sf, "tarife").select("satz_nr", F.array_compact(flags).alias("merkmale"))
