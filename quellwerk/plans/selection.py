"""Queries of selections, pages, series and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quellwerk.operators import relational as R
from quellwerk.operators import selection as X
from quellwerk.plans.catalog import query
from quellwerk.session import scalar, table

_W = "CASE WHEN image_url IS NULL THEN 0 ELSE length(title) * 37 % 900 + 200 END"
_ONE = f"i AS (SELECT id, url, region, source_name, operator, published, image_url, eingang_am, {_W} AS breite, length(title) % 4 AS ctm, length(url) % 6 AS relevanz FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY eingang_am NULLS FIRST, url NULLS FIRST, title NULLS FIRST) AS nr FROM items WHERE id IS NOT NULL) WHERE nr = 1)"
_ORDER = "published DESC NULLS LAST, id"


def _items(spark, sf):
    """One row per id with a made-up image width (the tables hold none) and two scores."""
    first = R.latest(table(spark, sf, "items").where("id is not null"), ["id"], [F.col(c).asc_nulls_first() for c in ("eingang_am", "url", "title")])
    width = F.when(F.col("image_url").isNull(), 0).otherwise(F.length("title") * 37 % 900 + 200)
    return first.select("id", "url", "region", "source_name", "operator", "published", "image_url", "eingang_am", width.alias("breite"), (F.length("title") % 4).alias("ctm"), (F.length("url") % 6).alias("relevanz"))


def _newest():
    return [F.col("published").desc_nulls_last(), F.col("id").asc()]


@query(
    f"""WITH {_ONE}, s AS (SELECT *, row_number() OVER (PARTITION BY region, source_name ORDER BY {_ORDER}) AS s FROM i), o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {_ORDER}) AS o FROM s WHERE s <= 2),
l AS (SELECT *, first_value(o) OVER (PARTITION BY region ORDER BY CASE WHEN breite >= 600 THEN 0 ELSE 1 END, o) AS l FROM o WHERE o <= 14), p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY CASE WHEN o = l THEN 0 ELSE 1 END, o) AS platz FROM l)
SELECT region, id, platz, CASE WHEN platz <= 1 THEN 0 WHEN platz <= 3 THEN 1 WHEN platz <= 7 THEN 2 ELSE 3 END AS stufe FROM p"""
)
def e5_front_page(spark, sf):
    """Fourteen places per region in four sizes, at most two of a sender, a wide image on top."""
    return X.front_page(_items(spark, sf), ["region"], "source_name", _newest(), "breite").select("region", "id", "platz", "stufe")


@query(
    f"""WITH {_ONE}, o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {_ORDER}) AS o FROM i), l AS (SELECT region, id FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY CASE WHEN breite >= 500 THEN 0 ELSE 1 END, o) AS r FROM o WHERE o <= 5) WHERE r = 1),
c AS (SELECT i.region, i.id, row_number() OVER (PARTITION BY i.region ORDER BY CASE WHEN breite >= 500 THEN 0 ELSE 1 END, i.published DESC NULLS LAST, i.id) AS platz FROM i LEFT JOIN l ON l.id = i.id WHERE l.id IS NULL)
SELECT region, id, 'lead' AS rolle, 0 AS platz FROM l UNION ALL SELECT region, id, 'begleiter', platz FROM c WHERE platz <= 3"""
)
def e6_lead_and_companions(spark, sf):
    return X.lead_and_companions(_items(spark, sf).select("id", "region", "published", "breite"), ["region"], _newest(), "breite").select("region", "id", "rolle", "platz")


@query(
    f"""WITH {_ONE}, q AS (SELECT name, min(timeout_seconds) AS rang FROM quellen GROUP BY 1), j AS (SELECT i.id, image_url, coalesce(rang, 900) AS rang FROM i LEFT JOIN q ON i.source_name = q.name)
SELECT id, image_url, rang FROM (SELECT *, CASE WHEN image_url IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY image_url ORDER BY rang, id) END AS r FROM j) WHERE r = 1"""
)
def e16_ranked_without_twin_images(spark, sf):
    """Rank of the sender, 900 where it has none; of the records with the same image only the best stays."""
    q = table(spark, sf, "quellen").groupBy(F.col("name").alias("source_name")).agg(F.min("timeout_seconds").alias("rang"))
    j = _items(spark, sf).join(q, "source_name", "left").select("id", "image_url", F.coalesce("rang", F.lit(900.0)).alias("rang"))
    return X.first_of_each(j, "image_url", ["rang", "id"])


@query(
    f"""WITH {_ONE}, s AS (SELECT max(eingang_am) AS m FROM i), n AS (SELECT i.*, eingang_am > m - INTERVAL 10 DAY AS neu FROM i, s), r AS (SELECT region, id, neu, row_number() OVER (PARTITION BY region ORDER BY CASE WHEN neu THEN 0 ELSE 1 END, eingang_am DESC, id) AS platz FROM n)
SELECT region, id, neu, platz FROM r WHERE platz <= 3"""
)
def e17_new_entries(spark, sf):
    """The three newest per region; without new ones the last arrivals."""
    i = _items(spark, sf)
    last = scalar(i.agg(F.max("eingang_am")))
    new = i.withColumn("neu", F.col("eingang_am") > F.lit(last) - F.expr("interval 10 days")) if last else i.withColumn("neu", F.lit(False))
    return R.top_per_group(new, ["region"], [F.col("neu").cast("int").desc(), F.col("eingang_am").desc(), "id"], 3, "platz").select("region", "id", "neu", "platz")


@query(
    f"""WITH {_ONE}, q AS (SELECT url, count(DISTINCT source_name) AS quellen FROM items WHERE url IS NOT NULL GROUP BY 1) SELECT id, ctm, relevanz, coalesce(quellen, 0) AS quellen, row_number() OVER (ORDER BY ctm DESC, relevanz DESC, coalesce(quellen, 0) DESC, id) AS platz
FROM i LEFT JOIN q USING (url) QUALIFY platz <= 20"""
)
def e19_ranking_axis(spark, sf):
    """The first twenty by the shared axis: two scores, then the number of senders."""
    q = table(spark, sf, "items").where("url is not null").groupBy("url").agg(F.count_distinct("source_name").alias("quellen"))
    i = _items(spark, sf).join(q, "url", "left").select("id", "ctm", "relevanz", F.coalesce("quellen", F.lit(0)).alias("quellen"))
    return X.tail(i, [F.col("ctm").desc(), F.col("relevanz").desc(), F.col("quellen").desc(), F.col("id").asc()], 20)


@query("SELECT tarif_id, satz_nr, row_number() OVER w AS nr, row_number() OVER w = count(*) OVER (PARTITION BY tarif_id) AS letzter FROM tarife WINDOW w AS (PARTITION BY tarif_id ORDER BY eingang_am, satz_nr)")
def e20_series(spark, sf):
    return X.series(table(spark, sf, "tarife").select("tarif_id", "satz_nr", "eingang_am"), "tarif_id", [F.col("eingang_am"), F.col("satz_nr")]).select("tarif_id", "satz_nr", "nr", "letzter")


@query(
    f"""WITH {_ONE}, r AS (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY relevanz DESC, {_ORDER}) AS r FROM i WHERE operator IS NOT NULL)
SELECT operator, max(CASE WHEN r = 1 THEN id END) AS lead, max(CASE WHEN r = 1 THEN breite END) >= 900 AND count(*) - 1 >= 3 AS gross, count(*) AS alle, count(published) AS belegt FROM r GROUP BY operator"""
)
def e21_brand_blocks(spark, sf):
    """Per brand the lead, whether it gets a large block, and totals over all and over dated records."""
    i = _items(spark, sf).where("operator is not null")
    order = F.struct(-F.col("relevanz"), F.col("published").isNull(), -F.unix_micros(F.col("published").cast("timestamp")), F.col("id"))
    g = i.groupBy("operator").agg(F.min_by(F.struct("id", "breite"), order).alias("l"), F.count("*").alias("alle"), F.count("published").alias("belegt"))
    return g.select("operator", F.col("l.id").alias("lead"), ((F.col("l.breite") >= 900) & (F.col("alle") - 1 >= 3)).alias("gross"), "alle", "belegt")


@query(
    r"""WITH t AS (SELECT lower(trim(item_id)) AS schluessel, array_to_string(absaetze, chr(10) || chr(10)) AS text, row_number() OVER (PARTITION BY lower(trim(item_id)) ORDER BY lauf DESC, zeilen_nr DESC) AS r FROM uebersetzungen WHERE trim(item_id) != '' AND len(absaetze) > 0)
SELECT schluessel, left(sha256(text), 12) AS hash, len(regexp_extract_all(text, '\{\{[^{}]*\}\}')) AS offen FROM t WHERE r = 1"""
)
def e22_latest_texts(spark, sf):
    """The latest edition of every text with its hash and its open fields."""
    u = table(spark, sf, "uebersetzungen").where("size(absaetze) > 0 and trim(item_id) != ''")
    return X.latest_text(u, F.lower(F.trim("item_id")), ["lauf", "zeilen_nr"], F.array_join("absaetze", "\n\n")).select("schluessel", "hash", "offen")


@query(
    """WITH p AS (SELECT tarif_id, first(grundgebuehr ORDER BY eingang_am, satz_nr) AS erst, last(grundgebuehr ORDER BY eingang_am, satz_nr) AS letzt FROM tarife WHERE grundgebuehr IS NOT NULL GROUP BY 1),
s AS (SELECT tarif_id, date_diff('day', CAST(min(eingang_am) AS DATE), CAST(max(eingang_am) AS DATE)) AS tage FROM tarife GROUP BY 1)
SELECT s.tarif_id, tage, round(letzt - erst, 2) + 0.0 AS unterschied, round(100 * (letzt - erst) / nullif(erst, 0), 2) + 0.0 AS prozent FROM s LEFT JOIN p USING (tarif_id)"""
)
def e11_span_and_decay(spark, sf):
    """Days between the first and the last reading, and the price against the first one."""
    t = table(spark, sf, "tarife")
    at = F.struct("eingang_am", "satz_nr")
    p = t.where("grundgebuehr is not null").groupBy("tarif_id").agg(F.min_by("grundgebuehr", at).alias("erst"), F.max_by("grundgebuehr", at).alias("letzt"))
    s = t.groupBy("tarif_id").agg(F.date_diff(F.max("eingang_am"), F.min("eingang_am")).alias("tage")).join(p, "tarif_id", "left")
    d = F.col("letzt") - F.col("erst")
    return s.select("tarif_id", "tage", (F.round(d, 2) + F.lit(0.0)).alias("unterschied"), (F.round(F.try_divide(100 * d, F.nullif("erst", F.lit(0.0))), 2) + F.lit(0.0)).alias("prozent"))


@query(f"WITH {_ONE} SELECT id, published, row_number() OVER (ORDER BY {_ORDER}) AS platz FROM i QUALIFY platz <= 100")
def f1_freshest_first(spark, sf):
    """The hundred freshest, undated ones last."""
    return X.tail(_items(spark, sf).select("id", "published"), _newest(), 100)


_SLUGS = ("story", "news", "/n/")


@query("WITH u AS (SELECT DISTINCT url, CASE WHEN contains(url, 'story') THEN 0 WHEN contains(url, 'news') THEN 1 WHEN contains(url, '/n/') THEN 2 ELSE 3 END AS vorzug FROM items WHERE url IS NOT NULL) SELECT url, vorzug, row_number() OVER (ORDER BY vorzug, url) AS platz FROM u QUALIFY platz <= 60")
def f2_preferred_links(spark, sf):
    """Links by the first wanted word in them, then by address; the first sixty."""
    u = table(spark, sf, "items").where("url is not null").select("url").distinct()
    return X.tail(u.withColumn("vorzug", X.preference(F.col("url"), _SLUGS)), [F.col("vorzug").asc(), F.col("url").asc()], 60)


@query(
    f"""WITH {_ONE} SELECT 'datum' AS modus, id, platz FROM (SELECT id, row_number() OVER (ORDER BY {_ORDER}) AS platz FROM i) WHERE platz <= 20
UNION ALL SELECT 'betreiber', id, platz FROM (SELECT id, row_number() OVER (ORDER BY lower(coalesce(nullif(operator, ''), 'zz')), {_ORDER}) AS platz FROM i) WHERE platz <= 20
UNION ALL SELECT 'relevanz', id, platz FROM (SELECT id, row_number() OVER (ORDER BY relevanz DESC, {_ORDER}) AS platz FROM i) WHERE platz <= 20"""
)
def f5_sort_modes(spark, sf):
    """The explorer's three orders, the first twenty of each."""
    i = _items(spark, sf)
    modes = {"datum": [], "betreiber": [F.lower(F.coalesce(F.nullif("operator", F.lit("")), F.lit("zz")))], "relevanz": [F.col("relevanz").desc()]}
    parts = [X.tail(i, [*head, *_newest()], 20).select(F.lit(name).alias("modus"), "id", "platz") for name, head in modes.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT zeilen_nr, titel_de, row_number() OVER (ORDER BY zeilen_nr DESC) AS platz FROM uebersetzungen QUALIFY platz <= 50")
def f6_tail(spark, sf):
    """The last fifty stored lines."""
    return X.tail(table(spark, sf, "uebersetzungen").select("zeilen_nr", "titel_de"), [F.col("zeilen_nr").desc()], 50)


@query(
    """WITH s AS (SELECT c_mktsegment AS segment, c_custkey AS abo FROM customer), e AS (SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1998-07-01' GROUP BY 1 HAVING count(*) > 0)
SELECT '2026-01-01|' || left(sha256(s.segment), 12) || '|' || lpad(CAST(abo AS VARCHAR), 10, '0') AS schluessel, s.segment, abo, row_number() OVER (PARTITION BY s.segment ORDER BY abo) AS nr FROM s JOIN e ON s.segment = e.segment"""
)
def f9_send_plan(spark, sf):
    """Segments with entries times their subscribers, in a fixed order per segment."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    recent = table(spark, sf, "orders").where("o_orderdate >= timestamp'1998-07-01'").select(F.col("o_custkey").alias("c_custkey"))
    full = recent.join(c, "c_custkey").select("c_mktsegment").distinct()
    plan = c.join(full, "c_mktsegment", "left_semi").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("abo"))
    key = F.concat_ws("|", F.lit("2026-01-01"), F.substring(F.sha2("segment", 256), 1, 12), F.lpad(F.col("abo").cast("string"), 10, "0"))
    return plan.select(key.alias("schluessel"), "segment", "abo", F.row_number().over(Window.partitionBy("segment").orderBy("abo")).alias("nr"))
