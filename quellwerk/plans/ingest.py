"""Queries of the sources: documents are written from table rows and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.plans.catalog import query
from quellwerk.session import table
from quellwerk.sources import documents as D
from quellwerk.sources import tariff_text


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_ITEMS = "SELECT id, url, trim(regexp_replace(title, '[\\s\\x{00A0}]+', ' ', 'g')) AS titel FROM items WHERE url IS NOT NULL AND length(trim(title)) > 0"


@query(_ITEMS)
def a6_feed(spark, sf):
    """Every item as a feed document, parsed."""
    i = table(spark, sf, "items").where("url is not null and length(trim(title)) > 0")
    doc = F.concat(F.lit("<rss><channel><item><title>"), _escaped(F.col("title")), F.lit("</title><link>"), _escaped(F.col("url")), F.lit("</link><pubDate>Tue, 14 Jul 2026 08:00:00 GMT</pubDate></item></channel></rss>"))
    e = i.select("id", F.explode(D.parse_feed(doc)).alias("e"))
    return e.select("id", "e.url", "e.titel")


@query(_ITEMS)
def a10_json_records(spark, sf):
    """Every item inside an unknown JSON document, found by shape."""
    i = table(spark, sf, "items").where("url is not null and length(trim(title)) > 0")
    record = F.to_json(F.struct(F.col("title").alias("headline"), F.col("url").alias("link")))
    doc = F.concat(F.lit('{"data":{"page":1,"teasers":['), record, F.lit("]}}"))
    e = i.select("id", F.explode(D.parse_json(doc)).alias("e"))
    return e.select("id", "e.url", "e.titel")


@query("SELECT id, split_part(url, '#', 1) AS url, trim(regexp_replace(title, '[\\s\\x{00A0}]+', ' ', 'g')) AS titel FROM items WHERE url IS NOT NULL AND length(trim(regexp_replace(title, '[\\s\\x{00A0}]+', ' ', 'g'))) BETWEEN 25 AND 300")
def a14_page_links(spark, sf):
    """Links of pages, without menus and footers."""
    i = table(spark, sf, "items").where("url is not null")
    doc = F.concat(F.lit('<nav><a href="/menu">A menu entry that is long enough to count</a></nav><a href="'), _escaped(F.col("url")), F.lit('">'), _escaped(F.col("title")), F.lit('</a><footer><a href="/imprint">An imprint entry that is long enough</a></footer>'))
    e = i.select("id", F.explode(D.parse_links(doc, F.col("url"))).alias("e"))
    return e.select("id", "e.url", "e.titel")


@query("SELECT satz_nr, name, printf('%.2f', grundgebuehr) AS preis FROM tarife WHERE grundgebuehr IS NOT NULL AND length(name) > 0")
def a38_structured_products(spark, sf):
    """schema.org products from the JSON-LD of pages."""
    t = table(spark, sf, "tarife").where("grundgebuehr is not null and length(name) > 0")
    offer = F.struct(F.format_string("%.2f", "grundgebuehr").alias("price"), F.lit("EUR").alias("priceCurrency"))
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("name"), offer.alias("offers")))
    doc = F.concat(F.lit('<html><script type="application/ld+json">{"@graph":['), ld, F.lit("]}</script></html>"))
    e = t.select("satz_nr", F.explode(D.parse_products(doc)).alias("e"))
    return e.select("satz_nr", "e.name", "e.preis")


@query("SELECT satz_nr, laufzeit_monate, CAST(printf('%.2f', grundgebuehr) AS DOUBLE) AS grundgebuehr, 'Mindestlaufzeit: ' || laufzeit_monate || ' Monate' AS beleg FROM tarife WHERE laufzeit_monate IS NOT NULL AND grundgebuehr IS NOT NULL")
def a31_tariff_sheet(spark, sf):
    """Fields of tariff sheets with the lines that prove them."""
    t = table(spark, sf, "tarife").where("laufzeit_monate is not null and grundgebuehr is not null").withColumnRenamed("laufzeit_monate", "lz").withColumnRenamed("grundgebuehr", "gg")
    sheet = F.concat(F.lit("Produktinformationsblatt\nMindestlaufzeit: "), F.col("lz").cast("string"), F.lit(" Monate\nGrundgebühr: "), F.replace(F.format_string("%.2f", "gg"), F.lit("."), F.lit(",")), F.lit(" €\n"))
    out = tariff_text.extract(t.select("satz_nr", sheet.alias("blatt")), "blatt")
    return out.select("satz_nr", "laufzeit_monate", "grundgebuehr", F.col("beleg_laufzeit").alias("beleg"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}\\x{000B}]+', ' ', 'g')) AS sichtbar FROM documents WHERE text IS NOT NULL")
def a35_visible_text(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    page = F.concat(F.lit("<html><nav>Menü</nav><script>var a = 1;</script><p>"), _escaped(F.col("text")), F.lit("</p><footer>Fuß</footer></html>"))
    return d.select("doc_id", T.visible(page).alias("sichtbar"))


@query("SELECT q.name, q.kind, CASE WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status, coalesce(n, 0) AS n FROM quellen q LEFT JOIN (SELECT source_name, count(*) AS n FROM items GROUP BY 1) i ON q.name = i.source_name")
def a1_scan_status(spark, sf):
    """One status row per configured source."""
    q = table(spark, sf, "quellen").select("name", "kind")
    i = table(spark, sf, "items").groupBy(F.col("source_name").alias("name")).agg(F.count("*").alias("n"))
    return q.join(i, "name", "left").select("name", "kind", F.when(F.col("n").isNull(), "empty").otherwise("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT id, url, regexp_matches(lower(trim(title)), '^(home|news|contact|mehr|more|weiterlesen)$') OR length(trim(title)) < 12 AS leer FROM items")
def a17_junk_titles(spark, sf):
    t = F.lower(F.trim("title"))
    return table(spark, sf, "items").select("id", "url", (t.rlike("^(home|news|contact|mehr|more|weiterlesen)$") | (F.length(F.trim("title")) < 12)).alias("leer"))
