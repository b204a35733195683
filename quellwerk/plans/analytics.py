"""Queries of aggregations, scores, windows and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.operators import relational as R
from quellwerk.operators import scoring as S
from quellwerk.operators import similarity as M
from quellwerk.plans.catalog import query
from quellwerk.session import materialise, scalar, table

_TOK = "list_filter(string_split_regex(lower(replace(title, 'İ', 'i')), '[^a-z0-9äöüß]+'), lambda w: length(w) >= 4)"


@query(f"SELECT wort, count(*) AS df, round(1.0 / count(*), 6) AS gewicht FROM (SELECT DISTINCT id, url, unnest({_TOK}) AS wort FROM items) GROUP BY wort")
def d1_df_weights(spark, sf):
    w = table(spark, sf, "items").select("id", "url", F.explode(T.tokens(F.col("title"), 4)).alias("wort")).distinct()
    return w.groupBy("wort").agg(F.count("*").alias("df")).select("wort", "df", F.round(1.0 / F.col("df"), 6).alias("gewicht"))


@query(
    f"""WITH w AS (SELECT DISTINCT id, unnest({_TOK}) AS wort FROM items), d AS (SELECT wort, count(*) AS df FROM w GROUP BY wort)
SELECT id, list_sort(list(wort)) AS selten FROM w JOIN d USING (wort) WHERE df <= 5 GROUP BY id"""
)
def d2_rare_tokens(spark, sf):
    w = table(spark, sf, "items").select("id", F.explode(T.tokens(F.col("title"), 4)).alias("wort")).distinct()
    rare = w.groupBy("wort").agg(F.count("*").alias("df")).where("df <= 5").select("wort")
    return w.join(rare, "wort").groupBy("id").agg(F.array_sort(F.collect_list("wort")).alias("selten"))


@query(
    f"""WITH w AS (SELECT DISTINCT id, unnest({_TOK}) AS wort FROM items), d AS (SELECT wort, count(*) AS df FROM w GROUP BY wort), n AS (SELECT count(DISTINCT id) AS n FROM items)
SELECT id, list_sort(list(wort)) AS selten FROM w JOIN d USING (wort), n WHERE df <= greatest(3, n // 8) GROUP BY id"""
)
def d2_relative_rarity(spark, sf):
    """Words of a title that at most max(3, n div 8) of the n records have."""
    w = table(spark, sf, "items").select("id", F.explode(T.tokens(F.col("title"), 4)).alias("wort")).distinct()
    cap = max(3, scalar(table(spark, sf, "items").agg(F.count_distinct("id"))) // 8)
    rare = w.groupBy("wort").agg(F.count("*").alias("df")).where(F.col("df") <= cap).select("wort")
    return w.join(rare, "wort").groupBy("id").agg(F.array_sort(F.collect_list("wort")).alias("selten"))  # the words of one title


@query(
    f"""WITH w AS (SELECT DISTINCT id, source_name, unnest({_TOK}) AS wort FROM items), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT id, source_name FROM items)), d AS (SELECT wort FROM w, n GROUP BY wort, n HAVING count(*) BETWEEN 3 AND greatest(8, n // 5)), v AS (SELECT * FROM w WHERE wort IN (SELECT wort FROM d))
SELECT a.wort AS wort1, b.wort AS wort2, count(DISTINCT a.id) AS n, count(DISTINCT a.source_name) AS quellen FROM v a JOIN v b ON a.id = b.id AND a.source_name IS NOT DISTINCT FROM b.source_name AND a.wort < b.wort
GROUP BY 1, 2 HAVING count(DISTINCT a.id) >= 4 AND count(DISTINCT a.source_name) >= 3"""
)
def d3_relative_pairs(spark, sf):
    """Frequent word pairs, from words of at least three titles and at most max(8, n div 5) of the n titles."""
    i = table(spark, sf, "items")
    w = i.select("id", "source_name", F.explode(T.tokens(F.col("title"), 4)).alias("wort")).distinct()
    cap = max(8, i.select("id", "source_name").distinct().count() // 5)
    kept = w.join(w.groupBy("wort").agg(F.count("*").alias("n")).where((F.col("n") >= 3) & (F.col("n") <= cap)).select("wort"), "wort")
    lists = kept.groupBy("id", "source_name").agg(F.array_sort(F.collect_set("wort")).alias("ws"))  # the words of one title
    pairs = F.flatten(F.transform("ws", lambda x, n: F.transform(F.slice("ws", n + 2, F.size("ws")), lambda y: F.struct(x.alias("wort1"), y.alias("wort2")))))
    p = lists.select("id", "source_name", F.inline(pairs))
    return p.groupBy("wort1", "wort2").agg(F.count_distinct("id").alias("n"), F.count_distinct("source_name").alias("quellen")).where("n >= 4 and quellen >= 3")


@query(
    f"""WITH w AS (SELECT DISTINCT id, source_name, unnest({_TOK}) AS wort FROM items), d AS (SELECT wort FROM w GROUP BY wort HAVING count(*) BETWEEN 3 AND 40), v AS (SELECT * FROM w WHERE wort IN (SELECT wort FROM d))
SELECT a.wort AS wort1, b.wort AS wort2, count(DISTINCT a.id) AS n, count(DISTINCT a.source_name) AS quellen FROM v a JOIN v b ON a.id = b.id AND a.source_name IS NOT DISTINCT FROM b.source_name AND a.wort < b.wort
GROUP BY 1, 2 HAVING count(DISTINCT a.id) >= 4 AND count(DISTINCT a.source_name) >= 3"""
)
def d3_frequent_pairs(spark, sf):
    w = table(spark, sf, "items").select("id", "source_name", F.explode(T.tokens(F.col("title"), 4)).alias("wort")).distinct()
    kept = w.join(w.groupBy("wort").agg(F.count("*").alias("n")).where("n between 3 and 40").select("wort"), "wort")
    lists = kept.groupBy("id", "source_name").agg(F.array_sort(F.collect_set("wort")).alias("ws"))  # the words of one title
    pairs = F.flatten(F.transform("ws", lambda x, i: F.transform(F.slice("ws", i + 2, F.size("ws")), lambda y: F.struct(x.alias("wort1"), y.alias("wort2")))))
    p = lists.select("id", "source_name", F.inline(pairs))
    return p.groupBy("wort1", "wort2").agg(F.count_distinct("id").alias("n"), F.count_distinct("source_name").alias("quellen")).where("n >= 4 and quellen >= 3")


@query(
    """SELECT source_name, count(*) AS n, CAST(sum(CASE WHEN published IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS datiert, CAST(sum(CASE WHEN operator IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS zugeordnet,
round(sum(CASE WHEN operator IS NOT NULL THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN published IS NOT NULL THEN 1.0 ELSE 0 END), 0), 4) AS quote FROM items GROUP BY source_name"""
)
def d4_hit_rate(spark, sf):
    g = table(spark, sf, "items").groupBy("source_name").agg(F.count("*").alias("n"), F.count("published").alias("datiert"), F.count("operator").alias("zugeordnet"))
    return g.withColumn("quote", F.round(F.try_divide("zugeordnet", "datiert"), 4))


@query("SELECT origin, region, count(*) AS n, count(DISTINCT source_name) AS quellen, grouping(origin, region) AS ebene FROM items GROUP BY ROLLUP (origin, region)")
def d5_rollup(spark, sf):
    return table(spark, sf, "items").rollup("origin", "region").agg(F.count("*").alias("n"), F.count_distinct("source_name").alias("quellen"), F.grouping_id().cast("bigint").alias("ebene"))


@query(
    """WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS tag, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT tag, sum(n) AS alle FROM m GROUP BY 1),
s AS (SELECT tag, event_type, 100.0 * n / alle AS anteil, alle FROM m JOIN t USING (tag)),
w AS (SELECT tag, event_type, round(anteil, 4) AS anteil, round(anteil - avg(anteil) OVER (PARTITION BY event_type ORDER BY tag ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS abstand FROM s WHERE alle >= 5)
SELECT tag, event_type, anteil, abstand FROM w"""
)
def d6_share_trend(spark, sf):
    e = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("tag"), "event_type").agg(F.count("*").alias("n"))
    s = e.withColumn("alle", F.sum("n").over(Window.partitionBy("tag"))).withColumn("anteil", 100.0 * F.col("n") / F.col("alle")).where("alle >= 5")
    w = Window.partitionBy("event_type").orderBy("tag").rowsBetween(-5, -1)
    return s.select("tag", "event_type", F.round("anteil", 4).alias("anteil"), F.round(F.col("anteil") - F.avg("anteil").over(w), 4).alias("abstand"))


@query("SELECT anbieter, art, count(*) AS n, count(DISTINCT tarif_id) AS tarife, round(100.0 * count(*) / max(count(*)) OVER (), 4) AS balken FROM tarife GROUP BY anbieter, art")
def d8_counts_with_bars(spark, sf):
    g = table(spark, sf, "tarife").groupBy("anbieter", "art").agg(F.count("*").alias("n"), F.count_distinct("tarif_id").alias("tarife"))
    most = F.lit(scalar(g.agg(F.max("n"))))
    return g.select("anbieter", "art", "n", "tarife", F.round(100.0 * F.col("n") / most, 4).alias("balken"))


@query(
    """SELECT l_partkey, l_orderkey AS auftrag, l_linenumber AS zeile, l_extendedprice AS preis, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS r, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) WHERE r = 1"""
)
def d9_cheapest_representative(spark, sf):
    key = F.struct("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min(key).alias("m"), F.count("*").alias("n"))
    return g.select("l_partkey", F.col("m.l_orderkey").alias("auftrag"), F.col("m.l_linenumber").alias("zeile"), F.col("m.l_extendedprice").alias("preis"), "n")


@query(
    """SELECT p_brand, count(*) FILTER (WHERE p_type = 'ECONOMY') AS economy, count(*) FILTER (WHERE p_type = 'STANDARD') AS standard, count(*) FILTER (WHERE p_type = 'PROMO') AS promo, min(p_retailprice) AS von, max(p_retailprice) AS bis FROM part GROUP BY p_brand"""
)
def d10_pivot(spark, sf):
    p = table(spark, sf, "part")
    wide = p.groupBy("p_brand").pivot("p_type", ["ECONOMY", "STANDARD", "PROMO"]).count().na.fill(0)
    span = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("von"), F.max("p_retailprice").alias("bis"))
    return wide.join(span, "p_brand").select("p_brand", F.col("ECONOMY").alias("economy"), F.col("STANDARD").alias("standard"), F.col("PROMO").alias("promo"), "von", "bis")


@query("SELECT coalesce(q.name, i.source_name) AS quelle, coalesce(n, 0) AS n, q.name IS NULL AS unbekannt FROM quellen q FULL JOIN (SELECT source_name, count(*) AS n FROM items GROUP BY 1) i ON q.name = i.source_name")
def d11_coverage(spark, sf):
    i = table(spark, sf, "items").groupBy("source_name").agg(F.count("*").alias("n"))
    q = table(spark, sf, "quellen").select("name")
    return q.join(i, q.name == i.source_name, "full_outer").select(F.coalesce("name", "source_name").alias("quelle"), F.coalesce("n", F.lit(0)).alias("n"), F.col("name").isNull().alias("unbekannt"))


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS steigung, round(regr_intercept(l_extendedprice, l_quantity), 4) AS achse FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def d14_regression(spark, sf):
    return S.regression(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")


@query(
    """WITH p AS (SELECT satz_nr, preisphasen AS ps, anschlusspreis FROM tarife WHERE len(preisphasen) > 0),
e AS (SELECT satz_nr, anschlusspreis, list_sum(list_transform(ps, lambda x: greatest(least(coalesce(x.bis_monat, 24), 24) - x.von_monat + 1, 0) * coalesce(x.betrag, 0.0))) AS summe, list_max(list_transform(ps, lambda x: least(coalesce(x.bis_monat, 24), 24))) AS bis, coalesce(ps[-1].betrag, 0.0) AS letzter FROM p)
SELECT satz_nr, round((summe + greatest(24 - greatest(bis, 0), 0) * letzter + coalesce(anschlusspreis, 0)) / 24, 4) AS effektiv FROM e"""
)
def d16_effective_price(spark, sf):
    t = table(spark, sf, "tarife").where("size(preisphasen) > 0")
    return t.select("satz_nr", F.round((S.phase_total(F.col("preisphasen")) + F.coalesce("anschlusspreis", F.lit(0.0))) / 24, 4).alias("effektiv"))


@query("SELECT operator, count(*) AS n FROM items WHERE operator IS NOT NULL AND length(operator) >= 3 GROUP BY operator ORDER BY n DESC, operator LIMIT 12")
def d17_top_senders(spark, sf):
    """A top-k report."""
    g = table(spark, sf, "items").where("length(operator) >= 3").groupBy("operator").agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), "operator").limit(12)


@query("SELECT strftime(published, '%Y-%m') AS monat, count(*) AS n, min(published) AS von, max(published) AS bis, count(DISTINCT CAST(published AS DATE)) AS tage FROM items WHERE published IS NOT NULL GROUP BY 1")
def d22_monthly_spans(spark, sf):
    return table(spark, sf, "items").where("published is not null").groupBy(F.date_format("published", "yyyy-MM").alias("monat")).agg(
        F.count("*").alias("n"), F.min("published").alias("von"), F.max("published").alias("bis"), F.count_distinct(F.to_date("published")).alias("tage")
    )


_BM = "list_filter(string_split_regex(lower(replace(coalesce(title, '') || ' ' || coalesce(summary, ''), 'İ', 'i')), '[^a-z0-9äöüß]+'), lambda w: length(w) >= 3)"


@query(
    f"""WITH b AS (SELECT id, min({_BM}) AS ws FROM items GROUP BY id), d AS (SELECT id, ws, len(ws) AS dl FROM b), q(anfrage, wort) AS (VALUES ('preise','prices'),('preise','percent'),('masten','masts'),('masten','new'),('markt','spectrum'),('markt','sale')),
p AS (SELECT id, dl, unnest(ws) AS wort FROM d), tf AS (SELECT id, dl, wort, count(*) AS tf FROM p WHERE wort IN (SELECT wort FROM q) GROUP BY ALL), df AS (SELECT wort, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT count(*) AS n, avg(dl) AS a FROM d),
r AS (SELECT anfrage, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS punkte FROM tf JOIN df USING (wort) JOIN q USING (wort), s GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY anfrage ORDER BY punkte DESC, id) AS rang FROM r WHERE punkte >= 1.0) SELECT anfrage, id, round(punkte, 4) AS punkte, rang FROM k WHERE rang <= 8"""
)
def f3_bm25_topk(spark, sf):
    """A top-k search over all items."""
    i = table(spark, sf, "items")
    words = T.words(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))), 3)
    docs = i.select("id", words.alias("ws")).groupBy("id").agg(F.min("ws").alias("ws"))
    q = spark.createDataFrame([("preise", "prices"), ("preise", "percent"), ("masten", "masts"), ("masten", "new"), ("markt", "spectrum"), ("markt", "sale")], "anfrage string, wort string")
    return S.bm25(docs, "id", F.col("ws"), q, 1.0, 8).select("anfrage", "id", F.round("punkte", 4).alias("punkte"), F.col("rang").cast("bigint").alias("rang"))


@query(
    """WITH r AS (SELECT source, doc_id, published, row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, doc_id) AS runde, max(published) OVER (PARTITION BY source) AS lead FROM documents)
SELECT source, doc_id, runde FROM r WHERE runde <= 200 ORDER BY runde, lead DESC NULLS LAST, source LIMIT 200"""
)
def e1_round_robin(spark, sf):
    """A top-k selection that interleaves the sources."""
    return R.round_robin(table(spark, sf, "documents"), "source", [F.col("published").desc_nulls_last(), "doc_id"], "published", 200).select("source", "doc_id", F.col("runde").cast("bigint").alias("runde"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def e3_topk_per_group(spark, sf):
    return R.top_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT operator, id, url FROM (SELECT operator, id, url, row_number() OVER (PARTITION BY lower(operator) ORDER BY published DESC NULLS LAST, id, url, eingang_am) AS r FROM items WHERE operator IS NOT NULL) WHERE r = 1")
def e4_one_per_sender(spark, sf):
    i = table(spark, sf, "items").where("operator is not null").withColumn("k", F.lower("operator"))
    return R.latest(i, ["k"], [F.col("published").desc_nulls_last(), "id", "url", "eingang_am"]).select("operator", "id", "url")


@query("SELECT event_id, value - p AS sprung FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type != 'error' AND value IS NOT NULL) WHERE value >= 10 AND value - p >= 5")
def e7_lag_bottleneck(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").where("event_type != 'error' and value is not null").withColumn("p", F.lag("value").over(w))
    return e.where("value >= 10 and value - p >= 5").select("event_id", (F.col("value") - F.col("p")).alias("sprung"))


@query(
    """WITH w AS (SELECT tarif_id, satz_nr, grundgebuehr AS neu, lag(grundgebuehr) OVER (PARTITION BY tarif_id ORDER BY eingang_am, satz_nr) AS alt FROM tarife WHERE grundgebuehr IS NOT NULL)
SELECT tarif_id, satz_nr, round(neu - alt, 2) AS diff, round(100.0 * (neu - alt) / alt, 2) AS prozent FROM w WHERE alt > 0 AND abs(neu - alt) >= 0.01"""
)
def e9_price_moves(spark, sf):
    w = Window.partitionBy("tarif_id").orderBy("eingang_am", "satz_nr")
    t = table(spark, sf, "tarife").where("grundgebuehr is not null").withColumn("alt", F.lag("grundgebuehr").over(w)).where("alt > 0 and abs(grundgebuehr - alt) >= 0.01")
    d = F.col("grundgebuehr") - F.col("alt")
    return t.select("tarif_id", "satz_nr", F.round(d, 2).alias("diff"), F.round(100.0 * d / F.col("alt"), 2).alias("prozent"))


@query("SELECT tarif_id, satz_nr, dokument_hash FROM (SELECT *, row_number() OVER (PARTITION BY tarif_id ORDER BY eingang_am DESC, satz_nr DESC) AS r FROM tarife) WHERE r = 1")
def e13_latest_version(spark, sf):
    return R.latest(table(spark, sf, "tarife"), ["tarif_id"], [F.col("eingang_am").desc(), F.col("satz_nr").desc()]).select("tarif_id", "satz_nr", "dokument_hash")


@query("SELECT p_partkey, p_size = max(p_size) OVER (PARTITION BY p_brand) AS aktuell FROM part")
def e14_current_generation(spark, sf):
    p = table(spark, sf, "part")
    top = p.groupBy("p_brand").agg(F.max("p_size").alias("m"))
    return p.join(top, "p_brand").select("p_partkey", (F.col("p_size") == F.col("m")).alias("aktuell"))


_SIM = "list_distinct(list_filter(string_split_regex(lower(replace(title, 'İ', 'i')), '[^a-z0-9äöüß]+'), lambda w: length(w) >= 4))"


@query(
    f"""WITH w AS (SELECT id, min(title) AS title, min(published) AS p FROM items WHERE title IS NOT NULL GROUP BY id), t AS (SELECT id, p, {_SIM} AS ws FROM w), e AS (SELECT id, unnest(ws) AS wort FROM t), d AS (SELECT wort FROM e GROUP BY wort HAVING count(*) BETWEEN 2 AND 50),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM e a JOIN d USING (wort) JOIN e b USING (wort) WHERE a.id < b.id),
o AS (SELECT c.a, c.b, len(list_intersect(x.ws, y.ws)) AS n, least(len(x.ws), len(y.ws)) AS m, x.p AS pa, y.p AS pb FROM c JOIN t x ON x.id = c.a JOIN t y ON y.id = c.b)
SELECT a, b, round(n / m, 4) AS deckung FROM o WHERE n / m >= 0.5 AND (pa IS NULL OR pb IS NULL OR abs(epoch_us(pa) - epoch_us(pb)) <= 259200000000)"""
)
def c9_overlap_pairs(spark, sf):
    i = table(spark, sf, "items").where("title is not null").groupBy("id").agg(F.min("title").alias("title"), F.min("published").alias("p"))
    return M.overlap_pairs(i, "id", T.tokens(F.col("title"), 4), "p", 72, 0.5, 2, 50)


@query(
    f"""WITH i AS (SELECT id, min(title) AS title, min(published) AS p FROM items WHERE title IS NOT NULL GROUP BY id), t AS (SELECT id, p, list_distinct({_TOK}) AS w FROM i), n AS (SELECT * FROM t WHERE len(w) > 0)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 4) AS deckung FROM n a JOIN n b ON a.id < b.id AND (a.p IS NULL OR b.p IS NULL OR abs(epoch_us(a.p) - epoch_us(b.p)) <= 72 * 3600000000)
WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.5"""
)
def c9_all_overlap_pairs(spark, sf):
    """All pairs near in time that overlap enough, frequent words included."""
    i = table(spark, sf, "items").where("title is not null").groupBy("id").agg(F.min("title").alias("title"), F.min("published").alias("p"))
    return M.all_overlap_pairs(i.select("id", "p", T.tokens(F.col("title"), 4).alias("ws")), "id", F.col("ws"), "p", 72, 0.5)


@query()
def c6_star_clusters(spark, sf):
    """Clusters around their freshest member, over all pairs that overlap enough; iterative, so rows only."""
    i = table(spark, sf, "items").where("title is not null").groupBy("id").agg(F.min("title").alias("title"), F.min("published").alias("p"))
    n = M.numbered(i.select("id", "p", T.tokens(F.col("title"), 4).alias("ws")), ["p", "id"], "n")
    pairs = materialise(M.all_overlap_pairs(n, "n", F.col("ws"), "p", 72, 0.5), "pairs")
    s = M.stars(n.select("n", "p"), pairs, "n", "p", 8)
    head = n.select(F.col("n").alias("kopf"), F.col("id").alias("kopf_id"))
    return s.join(n.select("n", "id"), "n").join(head, "kopf").select("id", F.col("kopf_id").alias("kopf"))


@query(
    """WITH n AS (SELECT p_partkey, p_brand, list_sort(list_distinct(string_split(p_name, ' '))) AS w FROM part WHERE p_partkey >= 1000), o AS (SELECT p_brand, p_name, min(p_partkey) AS k, list_sort(list_distinct(string_split(p_name, ' '))) AS w FROM part WHERE p_partkey < 1000 GROUP BY 1, 2),
m AS (SELECT n.p_partkey, o.k, len(list_intersect(n.w, o.w)) / least(len(n.w), len(o.w)) AS s FROM n JOIN o USING (p_brand) WHERE len(list_intersect(n.w, o.w)) / least(len(n.w), len(o.w)) >= 0.6)
SELECT p_partkey, treffer FROM (SELECT n.p_partkey, m.k AS treffer, row_number() OVER (PARTITION BY n.p_partkey ORDER BY m.s DESC NULLS LAST, m.k) AS r FROM n LEFT JOIN m USING (p_partkey)) WHERE r = 1"""
)
def c11_fuzzy_upsert(spark, sf):
    p = table(spark, sf, "part").withColumn("w", F.array_distinct(F.split("p_name", " ")))
    new = p.where("p_partkey >= 1000").select("p_partkey", "p_brand", "w")
    known = p.where("p_partkey < 1000").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("k"), F.first("w").alias("v"))
    return M.fuzzy_upsert(new, known, "p_brand", "p_partkey", "w", "k", "v", 0.6).withColumnRenamed("k", "treffer")
