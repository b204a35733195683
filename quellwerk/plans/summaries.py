"""Queries of counts, ratios, histograms, scores and state over runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.operators import ledger as L
from quellwerk.operators import models
from quellwerk.operators import scoring as S
from quellwerk.operators import state
from quellwerk.plans.catalog import query
from quellwerk.session import table

_LOW = lambda c: f"lower(replace(coalesce({c}, ''), 'İ', 'i'))"


@query(
    """WITH e AS (SELECT DISTINCT trim(u) AS betreiber, origin FROM (SELECT origin, unnest(string_split(operator || ',' || coalesce(region, ''), ',')) AS u FROM items WHERE operator IS NOT NULL)),
n AS (SELECT trim(u) AS betreiber, count(*) AS n FROM (SELECT unnest(string_split(operator || ',' || coalesce(region, ''), ',')) AS u FROM items WHERE operator IS NOT NULL) GROUP BY 1),
j AS (SELECT n.betreiber, n.n, count(e.origin) AS hebel FROM n LEFT JOIN e USING (betreiber) GROUP BY 1, 2)
SELECT betreiber, n, hebel, CAST(round(100.0 * n / max(n) OVER ()) AS BIGINT) AS balken FROM j"""
)
def d7_market_picture(spark, sf):
    """Counts of comma-parted names, the levers of each, bars against the longest."""
    i = table(spark, sf, "items").where("operator is not null").select("origin", F.explode(F.split(F.concat_ws(",", "operator", F.coalesce("region", F.lit(""))), ",")).alias("u"))
    g = i.groupBy(F.trim("u").alias("betreiber")).agg(F.count("*").alias("n"), F.count_distinct("origin").alias("hebel"))
    top = g.agg(F.max("n")).first()[0] or 1  # one value
    return g.withColumn("balken", F.round(100.0 * F.col("n") / top).cast("bigint"))


@query("SELECT anbieter, count(DISTINCT tarif_id) AS tarife, count(DISTINCT dokument_url) AS dokumente FROM tarife WHERE confidence IN ('hoch', 'mittel') GROUP BY anbieter")
def d12_portfolio_depth(spark, sf):
    t = table(spark, sf, "tarife").where(F.col("confidence").isin("hoch", "mittel"))
    return t.groupBy("anbieter").agg(F.count_distinct("tarif_id").alias("tarife"), F.count_distinct("dokument_url").alias("dokumente"))


@query("WITH m AS (SELECT strftime(published, '%Y-%m') AS monat, count(*) AS n FROM items WHERE published IS NOT NULL GROUP BY 1) SELECT monat, n, round(n / max(n) OVER (), 4) AS anteil FROM m")
def d19_monthly_histogram(spark, sf):
    m = table(spark, sf, "items").where("published is not null").groupBy(F.date_format("published", "yyyy-MM").alias("monat")).agg(F.count("*").alias("n"))
    top = m.agg(F.max("n")).first()[0] or 1  # one value
    return m.withColumn("anteil", F.round(F.col("n") / F.lit(top), 4))


@query(
    f"""WITH i AS (SELECT * FROM items WHERE published >= TIMESTAMP '2026-05-01' AND published < TIMESTAMP '2026-05-31'), w AS (SELECT unnest(list_distinct(list_filter(string_split_regex({_LOW("title || ' ' || coalesce(summary, '')")}, '[^a-z0-9äöüß]+'), lambda w: length(w) >= 4))) AS wort FROM i)
SELECT wort, count(*) AS treffer FROM w GROUP BY wort"""
)
def d20_keyword_index(spark, sf):
    """How many records of thirty days hold each word of four letters and more."""
    i = table(spark, sf, "items").where("published >= timestamp_ntz'2026-05-01' and published < timestamp_ntz'2026-05-31'")
    return i.select(F.explode(T.tokens(F.concat_ws(" ", "title", F.coalesce("summary", F.lit(""))), 4)).alias("wort")).groupBy("wort").agg(F.count("*").alias("treffer"))


@query("SELECT kind, count(*) AS quellen, count(CASE WHEN abgenommen IS NULL THEN 1 END) AS offen, count(label) AS beschriftet, count(CASE WHEN timeout_seconds > 30 THEN 1 END) AS langsam FROM quellen GROUP BY kind")
def d23_source_census(spark, sf):
    g = table(spark, sf, "quellen").groupBy("kind")
    return g.agg(F.count("*").alias("quellen"), F.count_if(F.col("abgenommen").isNull()).alias("offen"), F.count("label").alias("beschriftet"), F.count_if(F.col("timeout_seconds") > 30).alias("langsam"))


@query(
    """SELECT CAST(ts AS DATE) AS tag, count(*) AS versandt, round(count(CASE WHEN event_type != 'error' THEN 1 END) / count(*), 4) AS quote, count(CASE WHEN event_type = 'error' THEN 1 END) * 4 > count(*) AS warnung FROM events GROUP BY 1"""
)
def d25_delivery_ratio(spark, sf):
    """Share that arrived per day, and a warning where more than a quarter did not."""
    bad = F.count_if(F.col("event_type") == "error")
    g = table(spark, sf, "events").groupBy(F.to_date("ts").alias("tag"))
    return g.agg(F.count("*").alias("versandt"), F.round(F.try_divide(F.count("*") - bad, F.count("*")), 4).alias("quote"), (bad * 4 > F.count("*")).alias("warnung"))


@query(
    """SELECT source_name, count(*) AS n, round(0.35 * count(*) + sum(length(coalesce(volltext, ''))) / 4000.0, 6) AS kosten, round(count(*) * 3600.0 / nullif(date_diff('second', min(eingang_am), max(eingang_am)), 0), 6) AS je_stunde FROM items GROUP BY source_name"""
)
def d26_cost_model(spark, sf):
    """What a source costs by records and characters, and how much it brings an hour."""
    seconds = F.unix_timestamp(F.max("eingang_am")) - F.unix_timestamp(F.min("eingang_am"))
    return table(spark, sf, "items").groupBy("source_name").agg(
        F.count("*").alias("n"),
        F.round(0.35 * F.count("*") + F.sum(F.length(F.coalesce("volltext", F.lit("")))) / 4000.0, 6).alias("kosten"),
        F.round(F.try_divide(F.count("*") * 3600.0, F.nullif(seconds, F.lit(0))), 6).alias("je_stunde"),
    )


@query(
    """WITH k AS (SELECT DISTINCT name FROM quellen), g AS (SELECT source_name AS name, count(*) AS n, count(published) AS datiert, count(DISTINCT url) AS neu FROM items GROUP BY 1)
SELECT k.name, round(g.datiert / nullif(g.n, 0), 4) AS datiert, round(g.neu / nullif(g.n, 0), 4) AS neu FROM k LEFT JOIN g USING (name)"""
)
def d28_ratios(spark, sf):
    """Shares per source; null where a source has no records."""
    g = table(spark, sf, "items").groupBy(F.col("source_name").alias("name")).agg(F.count("*").alias("n"), F.count("published").alias("d"), F.count_distinct("url").alias("u"))
    k = table(spark, sf, "quellen").select("name").distinct().join(g, "name", "left")
    return k.select("name", F.round(F.try_divide("d", "n"), 4).alias("datiert"), F.round(F.try_divide("u", "n"), 4).alias("neu"))


@query(
    """WITH l AS (SELECT CAST(ts AS DATE) AS lauf, count(*) AS alle, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS zugestellt, max(CASE WHEN event_type = 'error' THEN event_id END) AS letzte_warnung FROM events GROUP BY 1),
z AS (SELECT *, row_number() OVER (ORDER BY lauf DESC) AS nr FROM l) SELECT lauf, alle, zugestellt, letzte_warnung, CAST(sum(zugestellt) OVER (ORDER BY lauf) AS BIGINT) AS summe FROM z WHERE nr <= 12"""
)
def d29_last_runs(spark, sf):
    """The last twelve days as runs with running totals and the newest warning."""
    e = table(spark, sf, "events")
    runs = e.groupBy(F.to_date("ts").alias("lauf")).agg(F.count("*").alias("alle"), F.count_if(F.col("event_type") == "purchase").alias("zugestellt"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("letzte_warnung"))
    last = runs.orderBy(F.col("lauf").desc()).limit(12)
    return last.withColumn("summe", F.sum("zugestellt").over(Window.orderBy("lauf")))  # twelve rows


@query(
    """WITH g AS (SELECT CASE WHEN len(absaetze) IS NULL OR len(absaetze) = 0 THEN 'leer' WHEN sprache IS NULL OR sprache = '' THEN 'ohne Sprache' WHEN url IS NULL THEN 'ohne Adresse' WHEN quell_hash IS NULL THEN 'ohne Hash' WHEN item_id IS NULL THEN 'ohne Kennung' WHEN len(absaetze) < 3 THEN 'kurz' ELSE 'gut' END AS grund FROM uebersetzungen)
SELECT grund, count(*) AS n FROM g GROUP BY grund ORDER BY n DESC, grund LIMIT 6"""
)
def d30_reasons(spark, sf):
    """The six most frequent reasons."""
    n = F.size("absaetze")
    empty = F.col("absaetze").isNull() | (n == 0)
    reason = F.when(empty, "leer").when(F.coalesce("sprache", F.lit("")) == "", "ohne Sprache").when(F.col("url").isNull(), "ohne Adresse").when(F.col("quell_hash").isNull(), "ohne Hash").when(F.col("item_id").isNull(), "ohne Kennung").when(n < 3, "kurz").otherwise("gut")
    g = table(spark, sf, "uebersetzungen").groupBy(reason.alias("grund")).agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), "grund").limit(6)


@query("SELECT anbieter, CAST(sum(len(list_filter(coalesce(preisphasen, []), lambda p: p.betrag > 0))) AS BIGINT) AS phasen, count(DISTINCT dokument_url) AS seiten FROM tarife GROUP BY anbieter")
def g5_nested_counts(spark, sf):
    """Entries of nested arrays that meet a condition, per provider."""
    n = F.coalesce(F.size(F.filter("preisphasen", lambda p: p["betrag"] > 0)), F.lit(0))
    return table(spark, sf, "tarife").groupBy("anbieter").agg(F.sum(F.greatest(n, F.lit(0))).alias("phasen"), F.count_distinct("dokument_url").alias("seiten"))


@query(
    """WITH q AS (SELECT source_name, count(*) AS n FROM items WHERE origin != 'tech_watch' GROUP BY 1), h AS (SELECT source_name, count(DISTINCT id) AS m FROM items GROUP BY 1)
SELECT k.name, coalesce(q.n, h.m) AS neu, q.n IS NULL AND h.m IS NOT NULL AS nachgetragen FROM (SELECT DISTINCT name FROM quellen) k LEFT JOIN q ON q.source_name = k.name LEFT JOIN h ON h.source_name = k.name"""
)
def c25_backfill(spark, sf):
    """A count that the log lacks is filled from the history, and only there."""
    i = table(spark, sf, "items")
    q = i.where("origin != 'tech_watch'").groupBy(F.col("source_name").alias("name")).agg(F.count("*").alias("n"))
    h = i.groupBy(F.col("source_name").alias("name")).agg(F.count_distinct("id").alias("m"))
    k = table(spark, sf, "quellen").select("name").distinct().join(q, "name", "left").join(h, "name", "left")
    return k.select("name", F.coalesce("n", "m").alias("neu"), (F.col("n").isNull() & F.col("m").isNotNull()).alias("nachgetragen"))


@query("SELECT satz_nr, list_transform(list_filter(coalesce(preisphasen, []), lambda p: p.betrag >= 10), lambda p: 'ab ' || p.von_monat || ': ' || printf('%.2f', p.betrag)) AS phasen FROM tarife")
def c28_nested_enrichment(spark, sf):
    """Entries of an array kept and labelled."""
    kept = F.filter(F.coalesce("preisphasen", F.array().cast("array<struct<von_monat:int,bis_monat:int,betrag:double>>")), lambda p: p["betrag"] >= 10)
    return table(spark, sf, "tarife").select("satz_nr", F.transform(kept, lambda p: F.concat(F.lit("ab "), p["von_monat"].cast("string"), F.lit(": "), F.format_string("%.2f", p["betrag"]))).alias("phasen"))


@query("SELECT i.id, i.eingang_am, coalesce(nullif(trim(CASE WHEN length(i.title) % 3 = 0 THEN ' ' ELSE i.url END), ''), q.url) AS adresse FROM items i LEFT JOIN (SELECT name, min(url) AS url FROM quellen GROUP BY 1) q ON i.source_name = q.name")
def c29_fallback_address(spark, sf):
    """The deep link, else the page of the source."""
    q = table(spark, sf, "quellen").groupBy(F.col("name").alias("source_name")).agg(F.min("url").alias("seite"))
    own = F.nullif(F.trim(F.when(F.length("title") % 3 == 0, F.lit(" ")).otherwise(F.col("url"))), F.lit(""))
    return table(spark, sf, "items").join(q, "source_name", "left").select("id", "eingang_am", F.coalesce(own, F.col("seite")).alias("adresse"))


_HOME = ("net", "mobil")
_TOPIC = ("preis", "price", "mast", "anten")
_ANY = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"


@query(
    f"""SELECT id, url, eingang_am, CASE WHEN {_ANY('o', _HOME)} AND (origin = 'operator' OR {_ANY('t', _TOPIC)}) THEN 3 ELSE least(greatest(coalesce(CASE WHEN n % 5 != 0 THEN n % 7 - 1 END, CASE origin WHEN 'operator' THEN 2 WHEN 'industry_news' THEN 1 ELSE 0 END), 0), 2) END AS stufe
FROM (SELECT *, {_LOW('operator')} AS o, {_LOW('title')} AS t, length(title) AS n FROM items)"""
)
def b9_relevance_level(spark, sf):
    """3 by rule, else what a model said up to 2, else a table by origin."""
    o, t, n = T.low(F.coalesce("operator", F.lit(""))), T.low(F.col("title")), F.length("title")
    hit = lambda c, ws: F.greatest(*[F.contains(c, F.lit(w)) for w in ws])
    said = F.when(n % 5 != 0, n % 7 - 1)  # a stand-in for the model's answer
    table_value = F.when(F.col("origin") == "operator", 2).when(F.col("origin") == "industry_news", 1).otherwise(0)
    level = S.relevance_level(hit(o, _HOME), (F.col("origin") == "operator") | hit(t, _TOPIC), said, table_value)
    return table(spark, sf, "items").select("id", "url", "eingang_am", level.alias("stufe"))


_AXES = """a AS (SELECT p_partkey, CASE WHEN d < 0 THEN 0 WHEN d <= 14 THEN 3 WHEN d <= 30 THEN 2 WHEN d <= 90 THEN 1 ELSE 0 END AS dringend, CASE WHEN andere >= 4 THEN 3 WHEN andere >= 2 THEN 2 WHEN andere >= 1 THEN 1 ELSE 0 END AS schwung, least(greatest(p_size // 12, 0), 3) AS reichweite
FROM (SELECT p_partkey, p_size, p_size * 4 - 40 AS d, (SELECT count(DISTINCT q.p_brand) FROM part q WHERE q.p_type = p.p_type) - 1 AS andere FROM part p))"""


def _axes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size", "p_brand")
    others = p.groupBy("p_type").agg((F.count_distinct("p_brand") - 1).alias("andere"))
    j = p.join(others, "p_type")
    return j.select("p_partkey", S.urgency(F.col("p_size") * 4 - 40).alias("dringend"), S.momentum(F.col("andere")).alias("schwung"), S.clamped(F.floor(F.col("p_size") / 12)).alias("reichweite"))


@query(f"WITH {_AXES} SELECT p_partkey, dringend, schwung, reichweite FROM a")
def h21_axes(spark, sf):
    """Three axes of 0 to 3: days to the end, others that do the same, reach."""
    return _axes(spark, sf)


@query(
    f"""WITH {_AXES}, s AS (SELECT p_partkey, CAST(round_even(dringend * (2 / 4.0 / 3 * 100) + schwung * (1 / 4.0 / 3 * 100) + reichweite * (1 / 4.0 / 3 * 100), 0) AS INT) AS punkte FROM a),
l AS (SELECT s.*, p.p_brand, CASE WHEN punkte >= 60 THEN true WHEN punkte < 40 THEN false END AS kante FROM s JOIN part p USING (p_partkey))
SELECT p_partkey, punkte, coalesce(last_value(kante IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING), false) AS oben FROM l"""
)
def j5_scoring_pipeline(spark, sf):
    """Axes, one score, and a state with hysteresis per brand."""
    a = _axes(spark, sf)
    points = S.composite({c: F.col(c) for c in ("dringend", "schwung", "reichweite")}, {"dringend": 2, "schwung": 1, "reichweite": 1})
    scored = a.select("p_partkey", points.alias("punkte")).join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    return state.hysteresis(scored, "p_brand", ["p_partkey"], "punkte", 60, 40).select("p_partkey", "punkte", F.col("drin").alias("oben"))


@query(
    """WITH s AS (SELECT lower(item_id) AS k, max(quell_hash) AS v FROM uebersetzungen WHERE lauf < 4 AND item_id IS NOT NULL GROUP BY 1), n AS (SELECT lower(item_id) AS k, max(quell_hash) AS v FROM uebersetzungen WHERE lauf >= 4 AND item_id IS NOT NULL GROUP BY 1)
SELECT n.k, CASE WHEN s.v IS NULL THEN 'neu' WHEN s.v = n.v THEN 'gleich' ELSE 'anders' END AS stand FROM n LEFT JOIN s USING (k)"""
)
def i13_snapshot_state(spark, sf):
    """Hash of every text against the last snapshot: new, equal or changed."""
    u = table(spark, sf, "uebersetzungen").where("item_id is not null").select(F.lower("item_id").alias("k"), F.col("quell_hash").alias("v"), "lauf")
    return L.changed(u.where("lauf < 4"), u.where("lauf >= 4").groupBy("k").agg(F.max("v").alias("v")), "k", "v")


@query(
    """WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'wartet' WHEN 'purchase' THEN 'aktiv' WHEN 'error' THEN 'unzustellbar' END AS s FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
f AS (SELECT user_id, arg_min(s, (ts, event_id)) AS f, min(ts) AS seit FROM (SELECT user_id, s, ts, event_id FROM e WHERE s = 'unzustellbar') GROUP BY 1), l AS (SELECT user_id, arg_max(s, (ts, event_id)) AS l, max(ts) AS seit FROM e GROUP BY 1)
SELECT l.user_id, coalesce(f.f, l.l) AS stand, coalesce(f.seit, l.seit) AS seit FROM l LEFT JOIN f USING (user_id)"""
)
def i20_subscription_states(spark, sf):
    """Subscriptions folded from their events; an undeliverable one stays so."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("art"))
    return L.fold_states(e, "user_id", ["ts", "event_id"], {"signup": "wartet", "purchase": "aktiv", "error": "unzustellbar"}, ("unzustellbar",))


@query(
    """WITH p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS tag FROM events WHERE event_type = 'signup' AND isodow(ts) < 6), b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS tag FROM events WHERE event_type IN ('purchase', 'click'))
SELECT p.user_id, p.tag FROM p LEFT JOIN b USING (user_id, tag) WHERE b.user_id IS NULL"""
)
def i21_delivery_ledger(spark, sf):
    """Planned deliveries of working days that the ledger neither sent nor refused."""
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("tag"), "event_type", F.concat_ws("|", "user_id", F.to_date("ts")).alias("k"))
    plan = e.where("event_type = 'signup' and weekday(tag) < 5").select("k", "user_id", "tag").distinct()
    stand = F.when(F.col("event_type") == "purchase", "gesendet").when(F.col("event_type") == "click", "abgewiesen").otherwise("fehler")
    return L.deliveries(e.select("k", stand.alias("stand")), plan, "k").select("user_id", "tag")


@query(
    """WITH i AS (SELECT DISTINCT id, sprache, published FROM items WHERE id IS NOT NULL), c AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN sprache NOT IN ('', 'de') THEN 0 ELSE 1 END, published DESC NULLS LAST, id, sprache) AS r FROM i WHERE sprache IS NULL OR sprache != 'de'),
g AS (SELECT CASE WHEN r <= 40 THEN 'dran' ELSE 'warten' END AS grund FROM c UNION ALL SELECT 'nichts zu tun' FROM i WHERE sprache = 'de') SELECT grund, count(*) AS n FROM g GROUP BY grund"""
)
def i23_bounded_enrichment(spark, sf):
    """Forty records a run, foreign ones for certain first; the reasons of all."""
    i = table(spark, sf, "items").where("id is not null").select("id", "sprache", "published").distinct()
    foreign = F.coalesce(~F.col("sprache").isin("", "de"), F.lit(False))
    return L.bounded(i, F.col("sprache").isNull() | (F.col("sprache") != "de"), foreign, [F.col("published").desc_nulls_last(), F.col("id"), F.col("sprache")], 40).groupBy("grund").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def i24_merge_on_write(spark, sf):
    """Three writes, one of them repeated, into a table that keeps the last row of every key."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    store = L.Merged(spark)
    for part in (0, 1, 1, 2):
        out = store.write(o.where(F.col("o_orderkey") % 3 == part), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out


@query("SELECT satz_nr, CASE WHEN satz_nr % 97 = 0 THEN 'behalten' WHEN lower(name) LIKE '%5g%' THEN 'ja' ELSE 'nein' END AS urteil FROM tarife WHERE name IS NOT NULL")
def j2_model_predicate(spark, sf):
    """A predicate answered by a model in batches; a row the model fails on is kept, alone."""

    def model(texts):
        if any(x.endswith("#97") for x in texts):
            raise ValueError("no answer")
        return ["ja" if "5g" in x.lower() else "nein" for x in texts]

    t = table(spark, sf, "tarife").where("name is not null").select("satz_nr", F.concat("name", F.when(F.col("satz_nr") % 97 == 0, F.lit("#97")).otherwise(F.lit(""))).alias("t"))
    asked = models.apply(t, "t", model, "antwort", "stand")
    return asked.select("satz_nr", F.when(F.col("stand") == "ok", F.col("antwort")).otherwise("behalten").alias("urteil"))


@query(
    """WITH b AS (SELECT source_name, count(*) * 0.5 AS s FROM items WHERE source_name IS NOT NULL GROUP BY 1), k AS (SELECT *, sum(s) OVER (ORDER BY s, source_name ROWS UNBOUNDED PRECEDING) AS bisher FROM b) SELECT source_name, bisher <= 300 AS laeuft FROM k"""
)
def i22_time_budget(spark, sf):
    """Stages that still fit into the time left, the short ones first; one row per source, of which there are few."""
    b = table(spark, sf, "items").where("source_name is not null").groupBy("source_name").agg((F.count("*") * 0.5).alias("s"))
    w = Window.orderBy("s", "source_name").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as configured sources
    return b.select("source_name", (F.sum("s").over(w) <= 300).alias("laeuft"))
