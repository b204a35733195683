"""Queries of what meets the outside: fetching, documents, search, sending, indexes; the clients are stand-ins that answer by the address."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.operators import models
from quellwerk.operators import relational as R
from quellwerk.plans.catalog import query
from quellwerk.session import table
from quellwerk.sources import fetch as W

_LOW = lambda c: f"lower(replace(coalesce({c}, ''), 'İ', 'i'))"


def _answer(url, headers, timeout):
    """A client for tests: the length of an address says how its host behaves."""
    n = len(url) % 6
    if n == 1 and headers["User-Agent"].startswith("quellwerk"):
        return 403, ""
    return {2: (404, ""), 3: (503, "")}.get(n, (200, f"body of {url}"))


@query(
    """SELECT DISTINCT url, CAST(CASE length(url) % 6 WHEN 2 THEN 404 WHEN 3 THEN 503 ELSE 200 END AS INT) AS status, CAST(CASE length(url) % 6 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS INT) AS versuche, CASE WHEN length(url) % 6 IN (2, 3) THEN 'fehler' END AS grund,
  CASE WHEN length(url) % 6 NOT IN (2, 3) THEN 'body of ' || url END AS inhalt FROM items WHERE url IS NOT NULL AND url != ''"""
)
def a4_fetch(spark, sf):
    """Every address once: names are swapped when refused, passing faults are waited for, a host is visited by one task."""
    u = table(spark, sf, "items").where("url is not null and url != ''").select("url").distinct()
    return W.fetched(u, "url", _answer, gap=0.0, sleep=lambda s: None, clock=lambda: 0.0).select("url", "status", "versuche", "grund", "inhalt")


@query(
    """WITH w AS (SELECT url, row_number() OVER (PARTITION BY source_name ORDER BY url) AS nr FROM (SELECT DISTINCT source_name, url FROM items WHERE url IS NOT NULL AND source_name IS NOT NULL)) SELECT url, nr <= 40 AS gelesen FROM w"""
)
def a41_capped_crawl(spark, sf):
    """At most forty pages a vendor are read; the others are named, so that nobody takes the vendor for read whole."""
    i = table(spark, sf, "items").where("url is not null and source_name is not null").select("source_name", "url").distinct()
    read = R.top_per_group(i, ["source_name"], [F.col("url")], 40, "nr").select("source_name", "url", F.lit(True).alias("g"))
    return i.join(read, ["source_name", "url"], "left").select("url", F.coalesce("g", F.lit(False)).alias("gelesen"))


@query(
    r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' ELSE 'text' END AS art, CASE WHEN doc_id % 3 != 0 THEN 'Nr. ' || doc_id END AS text, left(sha256(CASE doc_id % 3 WHEN 0 THEN '%PDF-1.7 ' || doc_id WHEN 1 THEN '<html><p>Nr. ' || doc_id || '</p></html>' ELSE 'Nr.  ' || doc_id END), 32) AS hash FROM documents"""
)
def a30_documents(spark, sf):
    """Fetched bytes by what they are, with their hash."""
    n = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), n)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<html><p>Nr. "), n, F.lit("</p></html>"))).otherwise(F.concat(F.lit("Nr.  "), n))
    d = table(spark, sf, "documents").select("doc_id", W.document(F.encode(raw, "UTF-8"), F.lit("")).alias("d"))
    return d.select("doc_id", "d.art", "d.text", "d.hash")


@query("SELECT name, kind, 'https://' || kind || '.example/' || n.i AS url, kind || ' ' || n.i AS titel FROM quellen, (VALUES (1), (2)) n(i) WHERE kind != 'official'")
def j6_search(spark, sf):
    """Hits of a search per source; a question that fails has none."""

    def search(q):
        if q == "official":
            raise ValueError("no answer")
        return [(f"{q} {i}", f"https://{q}.example/{i}") for i in (1, 2)]

    return W.searched(table(spark, sf, "quellen").select("name", "kind"), "kind", search)


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'gesendet' WHEN 1 THEN 'abgewiesen' ELSE 'offen' END AS stand FROM customer")
def a52_sent(spark, sf):
    """Deliveries by the answer: sent, refused for ever, or open for another try."""

    def send(record):
        if record["c_custkey"] % 4 == 3:
            raise OSError
        return (202, 410, 503)[record["c_custkey"] % 4]

    return W.sent(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", send)


@query(f"SELECT wort, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split_regex({_LOW('title')}, '[^a-z0-9äöüß]+'), lambda w: length(w) >= 4))) AS wort FROM items WHERE id IS NOT NULL AND title IS NOT NULL) GROUP BY wort")
def a49_indexes(spark, sf):
    """The keyword index that is written beside the search index, read back."""
    i = table(spark, sf, "items").where("id is not null and title is not null")
    paths = W.published(i, F.struct("id", "title", "url", "operator"), T.tokens(F.col("title"), 4), "id")
    return spark.read.schema("wort string, n bigint").json(paths["stichworte"])


@query(
    """WITH i AS (SELECT DISTINCT id, region, published, title, source_name FROM items WHERE id IS NOT NULL AND region IS NOT NULL AND title IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY length(title) % 6 DESC, published DESC NULLS LAST, id, title, source_name) AS platz FROM i),
q AS (SELECT region, source_name, row_number() OVER (PARTITION BY region ORDER BY n DESC, source_name) AS nr FROM (SELECT region, source_name, count(*) AS n FROM i WHERE source_name IS NOT NULL GROUP BY 1, 2))
SELECT region, 'zeile' AS art, platz AS nr, CASE WHEN length(title) <= 40 THEN title ELSE regexp_replace(left(title, 40), '\\s+\\S*$', '') || '…' END AS text FROM r WHERE platz <= 3 UNION ALL SELECT region, 'quelle', nr, source_name FROM q WHERE nr <= 12"""
)
def a51_slides(spark, sf):
    """Three headlines of forty characters and twelve sources for a slide per region."""
    i = table(spark, sf, "items").where("id is not null and region is not null and title is not null").select("id", "region", "published", "title", "source_name").distinct()
    top = R.top_per_group(i, ["region"], [(F.length("title") % 6).desc(), F.col("published").desc_nulls_last(), F.col("id"), F.col("title"), F.col("source_name")], 3, "nr")
    per = i.where("source_name is not null").groupBy("region", "source_name").agg(F.count("*").alias("n"))
    sources = R.top_per_group(per, ["region"], [F.col("n").desc(), F.col("source_name")], 12, "nr")
    return top.select("region", F.lit("zeile").alias("art"), "nr", T.truncated(F.col("title"), 40).alias("text")).union(sources.select("region", F.lit("quelle"), "nr", "source_name"))


@query(
    """WITH k AS (SELECT url, image_url AS bild, length(title) * 37 % 900 + 200 AS breite, eingang_am, id FROM items WHERE url IS NOT NULL AND image_url IS NOT NULL AND title IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY breite DESC, bild, id) AS r FROM k WHERE breite >= 400),
v AS (SELECT url, max(eingang_am) AS versucht FROM k GROUP BY 1), n AS (SELECT max(eingang_am) AS m FROM k)
SELECT v.url, r.bild, left(sha256(r.bild), 16) AS datei, r.bild IS NULL AND v.versucht < m - INTERVAL 30 DAY AS nochmal FROM v CROSS JOIN n LEFT JOIN r ON r.url = v.url AND r.r = 1"""
)
def a53_images(spark, sf):
    """The widest image of at least 400 pixels per record under a name by its hash; where none was wide enough it is tried again after thirty days."""
    k = table(spark, sf, "items").where("url is not null and image_url is not null and title is not null").select("url", F.col("image_url").alias("bild"), (F.length("title") * 37 % 900 + 200).alias("breite"), "eingang_am", "id")
    last = k.agg(F.max("eingang_am")).first()[0]
    wide = F.when(F.col("breite") >= 400, F.struct(-F.col("breite"), F.col("bild"), F.col("id")))
    g = k.groupBy("url").agg(F.min_by("bild", wide).alias("bild"), F.max("eingang_am").alias("v"))
    return g.select("url", "bild", F.substring(F.sha2("bild", 256), 1, 16).alias("datei"), (F.col("bild").isNull() & (F.col("v") < F.lit(last) - F.expr("interval 30 days"))).alias("nochmal"))


@query(
    r"""SELECT DISTINCT id, title FROM items WHERE id IS NOT NULL AND title IS NOT NULL AND len(list_filter(list_transform(regexp_extract_all(title, '\d+(?:[.,]\d+)?'), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)), lambda x: x >= 10 AND len(list_filter(list_transform(regexp_extract_all(coalesce(volltext, '') || ' ' || coalesce(summary, ''), '\d+(?:[.,]\d+)?'), lambda y: CAST(replace(y, ',', '.') AS DOUBLE)), lambda y: abs(x - y) <= 1)) = 0)) = 0 AND length(title) % 9 != 0"""
)
def b12_verified_claims(spark, sf):
    """Claims whose numbers are covered and that a model, asked in batches of ten, confirms; one it cannot answer for is removed."""
    from quellwerk.functions.rules import uncovered

    def model(texts):
        if any(len(x) % 9 == 0 for x in texts):
            raise ValueError("no answer")
        return ["ja"] * len(texts)

    source = F.concat_ws(" ", F.coalesce("volltext", F.lit("")), F.coalesce("summary", F.lit("")))
    i = table(spark, sf, "items").where("id is not null and title is not null").where(F.size(uncovered(F.col("title"), source)) == 0).select("id", "title")
    return models.apply(i, "title", model, "antwort", "stand", 10).where("stand = 'ok' and antwort = 'ja'").select("id", "title").distinct()


@query(
    """SELECT id, eingang_am, '<h2>' || k || '</h2><p>' || t || '</p><ul><li><a href="https://a.example/">mehr</a></li><li>[x](javascript:a)</li></ul>' AS html FROM (SELECT id, eingang_am, replace(replace(replace(coalesce(region, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS k,
  trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(title, '[*\\[\\]_]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'), '[\\s\\x{00A0}]+', ' ', 'g')) AS t FROM items WHERE region IS NOT NULL AND length(trim(title)) > 0)"""
)
def h12_safe_html(spark, sf):
    """Markdown as HTML of few elements; only http links become links."""
    clean = F.regexp_replace("title", r"[*\[\]_]", "")
    md = F.concat(F.lit("## "), "region", F.lit("\n\n"), clean, F.lit("\n\n- [mehr](https://a.example/)\n- [x](javascript:a)"))
    render = F.pandas_udf(lambda s: s.map(W.safe_html), "string", F.PandasUDFType.SCALAR)
    return table(spark, sf, "items").where("region is not null and length(trim(title)) > 0").select("id", "eingang_am", render(md).alias("html"))
