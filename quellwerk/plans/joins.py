"""Queries of filters, joins, set operations and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.functions import urls as U
from quellwerk.operators import relational as R
from quellwerk.plans.catalog import query
from quellwerk.session import table

_NOW = "2026-06-30 00:00:00"


@query(
    f"SELECT id, url, eingang_am FROM items WHERE published IS NULL OR (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(published)) / 86400000000.0 BETWEEN -1.0 AND 14.0"
)
def b1_freshness(spark, sf):
    return R.fresh(table(spark, sf, "items"), "published", F.to_timestamp(F.lit(_NOW)), 14).select("id", "url", "eingang_am")


@query("SELECT event_id, event_type, value FROM events WHERE event_type != 'error' AND (value IS NULL OR value >= 3) AND NOT contains(props, ': 1')")
def b8_candidate_filter(spark, sf):
    return table(spark, sf, "events").where("event_type != 'error' and (value is null or value >= 3) and not contains(props, ': 1')").select("event_id", "event_type", "value")


_THEMES = {"preis": ["preis", "price", "precio", "prix", "prezzi", "preços", "prijzen", "ceny"], "netz": ["mast", "antenn", "antenas"], "frequenz": ["frequenz", "spectrum", "subasta", "veiling", "frequenze"]}
_hits = lambda words: " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in words)


@query(
    f"""WITH h AS (SELECT id, url, eingang_am, lower(replace(title, 'İ', 'i')) AS t FROM items),
c AS (SELECT id, url, eingang_am, {', '.join(f'{_hits(w)} AS {k}' for k, w in _THEMES.items())} FROM h)
SELECT id, url, eingang_am, CASE WHEN preis + netz + frequenz = 0 THEN NULL WHEN preis >= netz AND preis >= frequenz THEN 'preis' WHEN netz >= frequenz THEN 'netz' ELSE 'frequenz' END AS thema FROM c"""
)
def b7_rule_classify(spark, sf):
    t = T.low(F.col("title"))
    n = {k: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in _THEMES.items()}
    best = F.greatest(*n.values())
    theme = F.when(best == 0, None)
    for k, c in n.items():
        theme = theme.when(c == best, F.lit(k))
    return table(spark, sf, "items").select("id", "url", "eingang_am", theme.alias("thema"))


@query(
    r"""SELECT id, url, eingang_am, len(list_filter(string_split_regex(trim(title), '\s+'), lambda w: w != '')) BETWEEN 4 AND 9 AS laenge,
  length(title) - length(replace(title, '.', '')) <= 2 AS punkte, regexp_matches(lower(replace(title, 'İ', 'i')), 'percent|prozent|ciento|cento|procent') AS folge FROM items"""
)
def b10_title_validator(spark, sf):
    words = F.size(F.filter(F.split(F.trim("title"), r"\s+"), lambda w: w != ""))
    return table(spark, sf, "items").select(
        "id", "url", "eingang_am", words.between(4, 9).alias("laenge"), (F.length("title") - F.length(F.replace("title", F.lit("."), F.lit(""))) <= 2).alias("punkte"), T.low(F.col("title")).rlike("percent|prozent|ciento|cento|procent").alias("folge")
    )


@query(
    r"""WITH n AS (SELECT id, url, eingang_am, list_distinct(regexp_extract_all(title, '\d+')) AS a, list_distinct(regexp_extract_all(coalesce(summary, ''), '\d+')) AS b FROM items)
SELECT id, url, eingang_am, list_sort(list_filter(a, lambda x: NOT list_contains(b, x) AND length(x) > 1)) AS ungedeckt FROM n"""
)
def b11_numbers_covered(spark, sf):
    n = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1))
    rows = table(spark, sf, "items").select("id", "url", "eingang_am", n(F.col("title")).alias("a"), n(F.coalesce("summary", F.lit(""))).alias("b"))
    return rows.select("id", "url", "eingang_am", F.array_sort(F.filter(F.array_except("a", "b"), lambda x: F.length(x) > 1)).alias("ungedeckt"))


#: name, regions, origins, words: empty = everything
_FILTERS = [("alle", [], [], []), ("europa", ["europe"], [], []), ("handel", ["europe", "asia_pacific"], ["industry_news"], []), ("wort", [], ["nirgends"], ["prices"])]
_SUB = "(VALUES " + ", ".join(f"('{n}', {r or '[]::VARCHAR[]'}, {o or '[]::VARCHAR[]'}, {w or '[]::VARCHAR[]'})" for n, r, o, w in _FILTERS) + ") AS f(abo, regionen, herkunft, woerter)"


@query(
    f"""SELECT abo, count(*) AS n, CAST(sum(CASE WHEN treffer THEN 1 ELSE 0 END) AS BIGINT) AS ueber_filter FROM (
SELECT abo, (len(regionen) = 0 OR list_contains(regionen, region)) AND (len(herkunft) = 0 OR list_contains(herkunft, origin)) AS treffer,
  len(list_filter(woerter, lambda w: contains(lower(replace(title, 'İ', 'i')), w))) > 0 AS wort FROM items, {_SUB}) WHERE treffer OR wort GROUP BY abo"""
)
def b14_filter_match(spark, sf):
    rows = table(spark, sf, "items").select("region", "origin", T.low(F.col("title")).alias("t"))
    each = [
        F.struct(
            F.lit(name).alias("abo"),
            ((F.lit(not regions) | F.col("region").isin(regions)) & (F.lit(not origins) | F.col("origin").isin(origins))).alias("treffer"),
            (F.lit(False) if not words else F.col("t").rlike("|".join(words))).alias("wort"),
        )
        for name, regions, origins, words in _FILTERS
    ]
    hit = rows.select(F.inline(F.array(*each))).where("treffer or wort")
    return hit.groupBy("abo").agg(F.count("*").alias("n"), F.sum(F.col("treffer").cast("int")).alias("ueber_filter"))


@query(
    r"""SELECT source_name, count(*) >= 5 AS genug, avg(CASE WHEN published IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8 AS datiert,
  count(DISTINCT title) >= 0.7 * count(*) AS verschieden, count(DISTINCT url) >= 0.9 * count(*) AS adressen FROM items GROUP BY source_name"""
)
def b22_quality_suite(spark, sf):
    g = table(spark, sf, "items").groupBy("source_name")
    return g.agg(
        (F.count("*") >= 5).alias("genug"),
        (F.avg(F.col("published").isNotNull().cast("int")) >= 0.8).alias("datiert"),
        (F.count_distinct("title") >= 0.7 * F.count("*")).alias("verschieden"),
        (F.count_distinct("url") >= 0.9 * F.count("*")).alias("adressen"),
    )


@query(
    """SELECT satz_nr, CASE WHEN isinf(datenvolumen_gb) THEN 0.0 WHEN datenvolumen_gb > 0 THEN round(grundgebuehr / datenvolumen_gb, 4) END AS je_gb,
  grundgebuehr IS NULL OR laufzeit_monate IS NULL AS quarantaene FROM tarife"""
)
def b26_price_per_gb(spark, sf):
    inf = F.col("datenvolumen_gb") == float("inf")
    per = F.when(inf, F.lit(0.0)).when(F.col("datenvolumen_gb") > 0, F.round(F.col("grundgebuehr") / F.col("datenvolumen_gb"), 4))
    return table(spark, sf, "tarife").select("satz_nr", per.alias("je_gb"), (F.col("grundgebuehr").isNull() | F.col("laufzeit_monate").isNull()).alias("quarantaene"))


@query(
    """SELECT id, url FROM (SELECT id, url, row_number() OVER (PARTITION BY id ORDER BY eingang_am, url, title) AS r FROM items WHERE id IS NOT NULL) WHERE r = 1
AND id NOT IN (SELECT lower(item_id) FROM uebersetzungen WHERE item_id IS NOT NULL)"""
)
def c1_novelty(spark, sf):
    seen = table(spark, sf, "uebersetzungen").select(F.lower("item_id").alias("id"))
    return R.unseen(table(spark, sf, "items").where("id is not null"), seen, "id", ["eingang_am", "url", "title"]).select("id", "url")


@query(
    r"""WITH op AS (SELECT DISTINCT operator AS name FROM items WHERE operator IS NOT NULL AND length(operator) >= 3),
r AS (SELECT DISTINCT id, ' ' || array_to_string(string_split_regex(lower(replace(title, 'İ', 'i')), '[^\p{L}\p{N}]+'), ' ') || ' ' AS p FROM items WHERE origin = 'industry_news')
SELECT id, p, name FROM (SELECT id, p, name, row_number() OVER (PARTITION BY id, p ORDER BY length(name) DESC, lower(name) DESC, name DESC) AS k FROM r, op WHERE contains(p, ' ' || lower(name) || ' ')) WHERE k = 1"""
)
def c2_operator_longest_match(spark, sf):
    items = table(spark, sf, "items").where("origin = 'industry_news'")
    p = F.concat(F.lit(" "), F.array_join(F.split(T.low(F.col("title")), r"[^\p{L}\p{N}]+"), " "), F.lit(" "))
    rows = items.select("id", p.alias("p")).distinct().withColumn("k", F.struct("id", "p"))
    terms = table(spark, sf, "items").where("operator is not null").select(F.col("operator").alias("term"), F.col("operator").alias("name")).distinct()
    return R.longest_term(rows, "k", "p", terms, "term", "name").select("k.id", "k.p", "name")


@query(
    """SELECT l_orderkey, l_linenumber, o_orderdate, coalesce(c_name, 'unbekannt') AS kunde FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey"""
)
def c3_enrich(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    out = rows.join(o, rows.l_orderkey == o.o_orderkey, "left").join(c, o.o_custkey == c.c_custkey, "left")
    return out.select("l_orderkey", "l_linenumber", "o_orderdate", F.coalesce("c_name", F.lit("unbekannt")).alias("kunde"))


@query("SELECT DISTINCT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def c4_semi_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(returned, "o_orderkey", "left_semi").distinct()


@query(
    """SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000
WHERE a.event_type = 'error' AND b.event_type = 'error'"""
)
def c8_interval_pairs(spark, sf):
    return R.near_in_time(table(spark, sf, "events").where("event_type = 'error'"), "user_id", "event_id", "ts", 2)


@query(
    """WITH g AS (SELECT p_brand, p_partkey, p_name, p_size, count(*) OVER (PARTITION BY p_brand, p_name, p_size) AS n FROM part) SELECT p_partkey, p_brand FROM g WHERE n = 1"""
)
def c12_unique_identity(spark, sf):
    p = table(spark, sf, "part")
    one = p.groupBy("p_brand", "p_name", "p_size").agg(F.count("*").alias("n"), F.first("p_partkey").alias("p_partkey")).where("n = 1")
    return one.select("p_partkey", "p_brand")


@query(
    """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS wert FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS wert FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.wert, b.wert) AS wert FROM a FULL JOIN b ON a.k = b.k"""
)
def c15_precedence_union(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    new, old = ("o_orderdate >= timestamp'1998-01-01'", "o_orderdate < timestamp'1998-01-01'")
    side = lambda cond: o.where(cond).groupBy("k").agg(F.max("o_totalprice").alias("wert"))
    return R.precedence_union([side(new), side(old)], "k", ["wert"])


@query(
    """WITH d AS (SELECT DISTINCT p_type FROM part), s AS (SELECT s_suppkey FROM supplier), h AS (SELECT DISTINCT l_suppkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT d.p_type, count(h.l_suppkey) AS lieferanten, (SELECT count(*) FROM s) - count(h.l_suppkey) AS fehlen FROM d LEFT JOIN h ON d.p_type = h.p_type GROUP BY d.p_type"""
)
def c16_gap_analysis(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    have = line.join(part, line.l_partkey == part.p_partkey).groupBy("p_type").agg(F.count_distinct("l_suppkey").alias("lieferanten"))
    total = F.lit(table(spark, sf, "supplier").count())
    out = part.select("p_type").distinct().join(have, "p_type", "left")
    n = F.coalesce("lieferanten", F.lit(0))
    return out.select("p_type", n.alias("lieferanten"), (total - n).alias("fehlen"))


@query(
    """SELECT e.event_id, e.user_id, p.value AS letzter FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts"""
)
def c18_as_of(spark, sf):
    e = table(spark, sf, "events")
    bought = e.where("event_type = 'purchase' and value is not null").groupBy("user_id", "ts").agg(F.max("value").alias("value")).withColumnRenamed("ts", "at")
    return R.as_of(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "at", "value", "letzter").select("event_id", "user_id", "letzter")


@query(
    """SELECT k.c_mktsegment, left(sha256(k.c_mktsegment || '|' || n.n_name), 12) AS segment, count(*) AS kunden FROM customer k JOIN nation n ON k.c_nationkey = n.n_nationkey GROUP BY k.c_mktsegment, n.n_name"""
)
def c22_segments(spark, sf):
    k, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    g = k.join(n, k.c_nationkey == n.n_nationkey).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("kunden"))
    return g.select("c_mktsegment", F.substring(F.sha2(F.concat_ws("|", "c_mktsegment", "n_name"), 256), 1, 12).alias("segment"), "kunden")


@query(
    """WITH t AS (SELECT l_suppkey AS s, list(DISTINCT l_partkey) FILTER (WHERE l_shipdate < TIMESTAMP '1998-01-01') AS o, list(DISTINCT l_partkey) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-01-01') AS n FROM lineitem GROUP BY 1),
d AS (SELECT s, list_sort(list_filter(coalesce(n, []), lambda x: NOT list_contains(coalesce(o, []), x))) AS dazu, list_sort(list_filter(coalesce(o, []), lambda x: NOT list_contains(coalesce(n, []), x))) AS weg FROM t)
SELECT s, dazu, weg FROM d WHERE len(dazu) > 0 OR len(weg) > 0"""
)
def g1_value_diff(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), "l_partkey", "l_shipdate")
    return R.value_diff(rows.where("l_shipdate < timestamp'1998-01-01'"), rows.where("l_shipdate >= timestamp'1998-01-01'"), ["s"], "l_partkey")


@query("SELECT DISTINCT name FROM quellen WHERE name NOT IN (SELECT source_name FROM items WHERE source_name IS NOT NULL)")
def g7_configured_without_data(spark, sf):
    q = table(spark, sf, "quellen").select("name")
    return q.join(table(spark, sf, "items").select(F.col("source_name").alias("name")).distinct(), "name", "left_anti").distinct()


@query(
    """SELECT 'item' AS art, id AS schluessel, title AS titel FROM items UNION ALL SELECT 'zeile', CAST(zeilen_nr AS VARCHAR), titel_original FROM uebersetzungen WHERE titel_original IS NOT NULL AND url IS NOT NULL
UNION ALL SELECT 'tarif', tarif_id, name FROM tarife"""
)
def g3_union_of_projections(spark, sf):
    a = table(spark, sf, "items").select(F.lit("item").alias("art"), F.col("id").alias("schluessel"), F.col("title").alias("titel"))
    b = table(spark, sf, "uebersetzungen").where("titel_original is not null and url is not null").select(F.lit("zeile").alias("art"), F.col("zeilen_nr").cast("string").alias("schluessel"), F.col("titel_original").alias("titel"))
    c = table(spark, sf, "tarife").select(F.lit("tarif").alias("art"), F.col("tarif_id").alias("schluessel"), F.col("name").alias("titel"))
    return a.unionByName(b).unionByName(c)


@query(
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
)
def g4_merge_latest_wins(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return R.latest(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), rank.desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT name, kind FROM (SELECT name, kind, row_number() OVER (ORDER BY name) - 1 AS i FROM quellen) WHERE (27 * 4 + i) % 12 < 4")
def g9_rotation(spark, sf):
    from pyspark.sql import Window

    q = table(spark, sf, "quellen").select("name", "kind").withColumn("i", F.row_number().over(Window.orderBy("name")) - 1)  # a dimension of 120 rows
    return q.where(F.pmod(F.lit(27 * 4) + F.col("i"), F.lit(12)) < 4).select("name", "kind")


@query(
    """SELECT a.id, a.url, b.title FROM (SELECT DISTINCT id, url FROM items WHERE origin = 'operator') a JOIN (SELECT lower(item_id) AS id, min(titel_original) AS title FROM uebersetzungen WHERE item_id IS NOT NULL GROUP BY 1) b ON a.id = b.id"""
)
def c21_lookup_join(spark, sf):
    a = table(spark, sf, "items").where("origin = 'operator'").select("id", "url").distinct()
    b = table(spark, sf, "uebersetzungen").where("item_id is not null").groupBy(F.lower("item_id").alias("id")).agg(F.min("titel_original").alias("title"))
    return a.join(b, "id").select("id", "url", "title")


@query(
    r"""WITH h AS (SELECT regexp_extract(regexp_replace(lower(regexp_extract(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://', ''), '^([^/?]*)', 1)), '^www\.', ''), '([^.]+\.[^.]+)$', 1) AS d, url FROM items WHERE url IS NOT NULL)
SELECT d, count(*) AS n, count(DISTINCT url) AS adressen FROM h GROUP BY d"""
)
def c26_url_index(spark, sf):
    return table(spark, sf, "items").where("url is not null").groupBy(U.registrable(F.col("url")).alias("d")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("adressen"))


@query("SELECT id, url, published FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY published DESC NULLS LAST, id, url, eingang_am) AS r FROM items) WHERE r <= 30")
def f7_region_cap(spark, sf):
    return R.top_per_group(table(spark, sf, "items"), ["region"], [F.col("published").desc_nulls_last(), "id", "url", "eingang_am"], 30).select("id", "url", "published")


@query(
    r"""WITH w AS (SELECT doc_id, lower(coalesce(betreiber, '')) AS o, lower(coalesce(source, '')) AS s, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, (CASE WHEN contains(o, 'net') THEN 8 WHEN contains(s, 'net') THEN 5 ELSE 2 END) + (CASE WHEN contains(o, 'fibra') THEN 8 WHEN contains(s, 'fibra') THEN 5 ELSE 2 END) AS gewicht
FROM w WHERE (contains(o, 'net') OR contains(s, 'net') OR contains(t, 'net')) AND (contains(o, 'fibra') OR contains(s, 'fibra') OR contains(t, 'fibra'))"""
)
def f4_weighted_search(spark, sf):
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    d = table(spark, sf, "documents").select("doc_id", low("betreiber").alias("o"), low("source").alias("s"), low("text").alias("t"))
    total = F.lit(0)
    for w in ("net", "fibra"):
        d = d.where(F.contains("o", F.lit(w)) | F.contains("s", F.lit(w)) | F.contains("t", F.lit(w)))
        total = total + F.when(F.contains("o", F.lit(w)), 8).when(F.contains("s", F.lit(w)), 5).otherwise(2)
    return d.select("doc_id", total.alias("gewicht"))


@query(
    """SELECT p_brand, p_partkey, p_name FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) >= 2)"""
)
def b21_gate_on_counts(spark, sf):
    p = table(spark, sf, "part")
    ok = p.groupBy("p_brand").agg(F.count_distinct("p_type").alias("n")).where("n >= 2").select("p_brand")
    return p.join(ok, "p_brand", "left_semi").select("p_brand", "p_partkey", "p_name")


_ = T
