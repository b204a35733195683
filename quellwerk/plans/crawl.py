"""Queries of the crawl: documents are written from table rows and read back; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.functions import urls as U
from quellwerk.plans.catalog import query
from quellwerk.session import new_folder, table
from quellwerk.sources import crawl as C
from quellwerk.sources import documents as D

_KEY = ["id", "url", "eingang_am"]
_PLAIN = r"trim(regexp_replace(title, '[\s\x{00A0}]+', ' ', 'g'))"
_HOST = r"regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.\-]*://', ''), '^([^/?#]*)', 1)), '^www\.', '')"


def _attribute(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _text(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _titled(spark, sf):
    return table(spark, sf, "items").where("url is not null and length(trim(title)) > 0")


@query(f"SELECT id, url, {_PLAIN} AS titel FROM items WHERE url IS NOT NULL AND length(trim(title)) > 0")
def a9_malformed_feed(spark, sf):
    """Feeds with bare ampersands, without their closing tags or with an entry that cannot be mended."""
    i = _titled(spark, sf)
    n = F.length("title") % 3
    title = F.when(n == 0, _text(F.col("title"))).otherwise(F.concat(F.lit("<![CDATA["), F.col("title"), F.lit("]]>")))
    entry = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), _text(F.col("url")), F.lit("</link>"))
    doc = F.when(n == 0, F.concat(F.lit("<rss><channel><copyright>A & B</copyright>"), entry, F.lit("</item></channel></rss>"))).when(n == 1, F.concat(F.lit("<rss><channel>"), entry, F.lit("</item>"))).otherwise(F.concat(F.lit("<rss><channel>"), entry, F.lit("<description>cut <b>off</description></item></channel>")))
    e = i.select("id", F.explode(D.parse_feed(doc)).alias("e"))
    return e.select("id", "e.url", "e.titel")


@query("SELECT id, url, image_url AS bild, CASE WHEN length(trim(v)) >= 1200 THEN length(trim(v)) END AS zeichen FROM (SELECT id, url, image_url, regexp_replace(coalesce(volltext, ''), '[\\s\\x{00A0}]+', ' ', 'g') AS v FROM items WHERE url IS NOT NULL)")
def a8_feed_media(spark, sf):
    """Media or first image of every entry, and its text where it is a full one."""
    n = F.length("title") % 2
    media = F.when(F.col("image_url").isNotNull() & (n == 0), F.concat(F.lit('<enclosure type="image/jpeg" url="'), _attribute(F.col("image_url")), F.lit('"/>'))).otherwise(F.lit(""))
    image = F.when(F.col("image_url").isNotNull() & (n == 1), F.concat(F.lit('&lt;img src="'), _attribute(F.col("image_url")), F.lit('"&gt;'))).otherwise(F.lit(""))
    doc = F.concat(F.lit("<rss><channel><item><link>"), _text(F.col("url")), F.lit("</link>"), media, F.lit("<description>"), image, _text(_text(F.coalesce("volltext", F.lit("")))), F.lit("</description></item></channel></rss>"))
    e = table(spark, sf, "items").where("url is not null").select("id", F.explode(D.parse_media(doc)).alias("e"))
    return e.select("id", "e.url", "e.bild", F.length("e.volltext").alias("zeichen"))


@query(f"SELECT id, url, {_PLAIN} AS titel FROM items WHERE url IS NOT NULL AND length(trim(title)) > 0")
def a15_attribute_records(spark, sf):
    """Records that a page holds as JSON in its attributes."""
    record = F.to_json(F.struct(F.col("title").alias("headline"), F.col("url").alias("link")))
    doc = F.concat(F.lit('<div class="cards" data-model="'), _attribute(F.concat(F.lit('{"cards":['), record, F.lit("]}"))), F.lit('"></div>'))
    e = _titled(spark, sf).select("id", F.explode(D._column(C.attribute_entries, C.RECORD, doc)).alias("e"))
    return e.select("id", "e.url", "e.titel")


@query(
    f"""SELECT i.id, i.url, {_PLAIN} AS titel, q.kind, q.url AS quelle FROM items i JOIN (SELECT name, min(url) AS url, min(kind) AS kind FROM quellen GROUP BY 1) q ON i.source_name = q.name
WHERE i.url IS NOT NULL AND length(trim(title)) > 0 AND kind IN ('rss', 'json_api', 'newsroom_js') AND NOT contains(i.url, 'story')"""
)
def a2_dispatch(spark, sf):
    """Every record in the format of its source's kind, read by the parser registered for it."""
    q = table(spark, sf, "quellen").groupBy(F.col("name").alias("source_name")).agg(F.min("url").alias("von"), F.min("kind").alias("kind"))
    record = F.to_json(F.struct(F.col("title").alias("headline"), F.col("url").alias("link")))
    feed = F.concat(F.lit("<rss><channel><item><title>"), _text(F.col("title")), F.lit("</title><link>"), _text(F.col("url")), F.lit("</link></item></channel></rss>"))
    doc = F.when(F.col("kind") == "rss", feed).when(F.col("kind") == "json_api", F.concat(F.lit("["), record, F.lit("]"))).otherwise(F.concat(F.lit('<p data-items="'), _attribute(F.concat(F.lit("["), record, F.lit("]"))), F.lit('">')))
    pages = _titled(spark, sf).join(q, "source_name").select("id", "kind", "von", doc.alias("roh"))
    return C.dispatched(pages, "kind", "roh", "von", "story").select("id", "e.url", "e.titel", "kind", "quelle")


@query(f"WITH h AS (SELECT DISTINCT {_HOST} AS host FROM items WHERE url IS NOT NULL), x AS (SELECT host FROM h UNION ALL SELECT 'm.' || host FROM h UNION ALL SELECT replace(host, '.example', '.co.uk') FROM h) SELECT host, CASE WHEN len(string_split(host, '.')) <= 2 OR regexp_replace(host, '^[^.]+\\.', '') = 'co.uk' THEN host ELSE regexp_replace(host, '^[^.]+\\.', '') END AS seite FROM x")
def a18_parent_site(spark, sf):
    """Hosts without their first label, public suffixes kept whole."""
    h = table(spark, sf, "items").where("url is not null").select(U.host(F.col("url")).alias("host")).distinct()
    x = h.select(F.explode(F.array("host", F.concat(F.lit("m."), F.col("host")), F.replace("host", F.lit(".example"), F.lit(".co.uk")))).alias("host"))
    return x.select("host", C.parent_site(F.col("host")).alias("seite"))


@query(
    f"""WITH n AS (SELECT regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AS domain, (['www', 'mail', 'tarif', 'shop'])[1 + length(title) % 4] || '.' || h AS name, published, eingang_am FROM (SELECT *, {_HOST} AS h FROM items WHERE url IS NOT NULL AND published IS NOT NULL)),
k AS (SELECT DISTINCT name FROM n WHERE published < TIMESTAMP '2026-02-01'), f AS (SELECT domain, name, min(published) AS zuerst FROM n WHERE NOT (name LIKE 'www.%' OR name LIKE 'mail.%') AND name NOT IN (SELECT name FROM k) GROUP BY 1, 2)
SELECT domain, name, zuerst FROM f WHERE domain IN (SELECT domain FROM f GROUP BY 1 HAVING count(*) <= 8)"""
)
def a23_certificate_names(spark, sf):
    """Names of certificates not seen before a day, technical ones and rollouts left out."""
    i = table(spark, sf, "items").where("url is not null and published is not null")
    label = F.element_at(F.array(*map(F.lit, ("www", "mail", "tarif", "shop"))), F.length("title") % 4 + 1)
    raw = F.concat(F.when(F.length("url") % 2 == 0, F.lit("*.")).otherwise(F.lit(" ")), F.upper(F.concat_ws(".", label, U.host(F.col("url")))), F.lit("."))
    n = i.select(U.registrable(F.col("url")).alias("domain"), C.certificate_name(raw).alias("name"), F.col("published").alias("not_before"))
    return C.new_names(n, n.where("not_before < timestamp_ntz'2026-02-01'"), ("www", "mail"))


@query("SELECT DISTINCT lower(trim(name)) || '.tarif.example' AS name FROM (SELECT DISTINCT regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS name FROM tarife WHERE name IS NOT NULL) WHERE name != ''")
def a24_normal_names(spark, sf):
    """DNS names in upper case, with wildcard and final dot, in their normal form."""
    t = table(spark, sf, "tarife").where("name is not null").select(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-").alias("n")).where("n != ''")
    return t.select(C.certificate_name(F.concat(F.lit(" *."), F.upper("n"), F.lit(".Tarif.Example."))).alias("name")).distinct()


@query("SELECT event_id, CAST(event_id % 5 + event_id % 7 AS INT) AS von, CAST(CASE WHEN event_id % 3 = 0 THEN (event_id % 5 + 2) * 7 ELSE event_id % 5 + 2 END + event_id % 7 + 1 AS INT) AS bis FROM events WHERE event_id % 3 != 0 UNION ALL SELECT event_id, CAST(event_id % 5 * 7 + event_id % 7 AS INT), CAST((event_id % 5 + 2) * 7 + event_id % 7 + 1 AS INT) FROM events WHERE event_id % 3 = 0")
def a26_schema_delivery(spark, sf):
    """Handling plus transit time of nested offers, weeks as seven days."""
    a, b = F.col("event_id") % 5, F.col("event_id") % 7
    unit = F.when(F.col("event_id") % 3 == 0, "WEEK").otherwise("DAY")
    span = lambda low, high, u: F.struct(low.alias("minValue"), high.alias("maxValue"), u.alias("unitCode"))
    times = F.struct(span(a, a + 2, unit).alias("handlingTime"), span(b, b + 1, F.lit("DAY")).alias("transitTime"))
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.struct(F.struct(times.alias("deliveryTime")).alias("shippingDetails")).alias("offers")))
    doc = F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))
    e = table(spark, sf, "events").select("event_id", F.explode(D._column(C.schema_delivery, C.DELIVERY, doc)).alias("e"))
    return e.select("event_id", "e.von", "e.bis")


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'feld' WHEN 1 THEN 'text' WHEN 4 THEN 'text' END AS methode, CASE event_id % 5 WHEN 0 THEN 'mittel' WHEN 1 THEN 'niedrig' WHEN 4 THEN 'niedrig' END AS belastbarkeit,
  CASE event_id % 5 WHEN 2 THEN 'kein treffer' WHEN 3 THEN 'platzhalter' WHEN 4 THEN 'zu lang' END AS quarantaene FROM events"""
)
def a25_delivery_cascade(spark, sf):
    """A selected field before free text; contract terms are no delivery times; placeholders and long times are quarantined."""
    n = F.col("event_id") % 5
    field = F.when(n == 0, "Lieferung in 2 Tagen")
    text = F.when(n == 1, "Versand innerhalb von 5 Werktagen, sonst binnen 5 Werktagen.").when(n == 2, "24 Tage Laufzeit. Widerruf binnen 14 Tagen.").when(n == 3, "Lieferzeit {{days}} Tage").when(n == 4, "Lieferzeit 14-20 Wochen").otherwise("nichts")
    e = table(spark, sf, "events").select("event_id", C.observed_delivery(F.array().cast(f"array<{C.DELIVERY}>"), field, text).alias("b"))
    return e.select("event_id", "b.methode", "b.belastbarkeit", "b.quarantaene")


@query(
    """WITH t AS (SELECT satz_nr, dokument_url AS url, regexp_extract(dokument_url, '^(https?://[^/]+)', 1) AS basis FROM tarife WHERE dokument_url IS NOT NULL) SELECT satz_nr, url, 'Blatt' AS titel FROM t WHERE NOT contains(url, '#')"""
)
def a29_document_links(spark, sf):
    """Links of a page to documents on its own host, the first of each."""
    t = table(spark, sf, "tarife").where("dokument_url is not null and not contains(dokument_url, '#')")
    href = _attribute(F.col("dokument_url"))
    doc = F.concat(F.lit('<a href="https://other.example/x.pdf">Fremd</a><a href="'), href, F.lit('">Blatt</a><a href="'), href, F.lit('">Blatt noch einmal</a>'))
    e = t.select("satz_nr", F.explode(D._column(lambda raw, base: C.document_links(raw, base, "."), D.LINK, doc, F.col("dokument_url"))).alias("e"))
    return e.select("satz_nr", "e.url", "e.titel")


@query("SELECT satz_nr, satz_nr % 3 = 0 AS blatt FROM tarife")
def a32_document_type(spark, sf):
    """Texts that name themselves a sheet and a price."""
    n = F.col("satz_nr") % 3
    text = F.when(n == 0, F.concat(F.lit("Produktinformationsblatt\n"), F.coalesce("name", F.lit("")), F.lit("\nGrundgebühr: 10 €"))).when(n == 1, F.lit("Produktinformationsblatt ohne Betrag")).otherwise(F.lit("Grundgebühr in einem Artikel"))
    return table(spark, sf, "tarife").select("satz_nr", C.is_tariff_document(text).alias("blatt"))


@query(
    """WITH t AS (SELECT satz_nr, grundgebuehr AS g FROM tarife WHERE grundgebuehr > 0 AND grundgebuehr < 900) SELECT satz_nr, unnest(['Monat 1-6', 'Monat 7-24', 'ab Monat 25']) AS kategorie, unnest([round(g, 2), round(g + 5, 2), round(g + 10, 2)]) AS preis FROM t"""
)
def a34_price_staircase(spark, sf):
    """Prices of a table under the nearest heading, by the columns of the text."""
    t = table(spark, sf, "tarife").where("grundgebuehr > 0 and grundgebuehr < 900")
    money = lambda c: F.lpad(F.concat(F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(",")), F.lit(" €")), 10, " ")
    sheet = F.concat(F.lit("                Monat 1-6       Monat 7-24      ab Monat 25\nGrundpreis     "), money(F.round("grundgebuehr", 2)), F.lit("      "), money(F.round(F.col("grundgebuehr") + 5, 2)), F.lit("       "), money(F.round(F.col("grundgebuehr") + 10, 2)), F.lit("\n"))
    e = t.select("satz_nr", F.explode(C.staircase(sheet)).alias("e"))
    return e.select("satz_nr", "e.kategorie", "e.preis")


@query(f"SELECT id, url, image_url AS bild, url AS link, {_PLAIN} AS ueber, image_url || '?w=2' AS gross FROM items WHERE url IS NOT NULL AND image_url IS NOT NULL AND length(trim(title)) > 0 AND NOT contains(url, '#') AND NOT contains(image_url, '#')")
def a36_page_candidates(spark, sf):
    """The page's picture, a link with the heading above it, an image with its widest source."""
    i = _titled(spark, sf).where("image_url is not null and not contains(url, '#') and not contains(image_url, '#')")
    image, href = _attribute(F.col("image_url")), _attribute(F.col("url"))
    doc = F.concat(F.lit('<meta property="og:image" content="'), image, F.lit('"><h2>'), _text(T.visible(_text(F.col("title")))), F.lit('</h2><a href="'), href, F.lit('">mehr <img src="/klein.png" srcset="'), image, F.lit("?w=1 300w, "), image, F.lit('?w=2 900w"></a><a href="https://other.example/">fremd</a>'))
    e = i.select("id", "url", F.explode(D._column(C.page_candidates, C.PAGE, doc, F.col("url"))).alias("e"))
    return e.select("id", "url", "e.bild", F.element_at("e.links", 1)["url"].alias("link"), F.element_at("e.links", 1)["ueber"].alias("ueber"), F.element_at("e.bilder", 1)["url"].alias("gross"))


@query("SELECT id, eingang_am, sha256(coalesce(title, '') || chr(10) || 'https://a.example/1' || chr(10) || 'https://a.example/2?x=' || length(title)) AS hash FROM items")
def a37_content_hash(spark, sf):
    """A hash that does not change with the order or the tracking of links."""
    links = F.array(F.concat(F.lit("http://www.a.example/2/?utm_source=x&x="), F.length("title").cast("string")), F.lit("https://a.example/1#top"), F.lit("https://A.example/1?fbclid=9"))
    return table(spark, sf, "items").select("id", "eingang_am", C.content_hash(F.col("title"), links).alias("hash"))


@query(
    """WITH t AS (SELECT doc_id, text AS v, left(text, 900) AS anriss, doc_id % 2 = 0 AND length(text) >= 1200 AS feed FROM documents)
SELECT doc_id, CASE WHEN feed THEN 'feed' WHEN grund IS NULL THEN 'artikel' END AS herkunft, CASE WHEN NOT coalesce(feed, false) THEN grund END AS grund FROM (SELECT *, CASE WHEN v IS NULL THEN 'nicht geholt' WHEN length(v) < 1200 THEN 'zu kurz' WHEN length(v) > 60000 THEN 'zu lang' WHEN length(v) < 1.5 * length(coalesce(anriss, '')) THEN 'nur anriss' END AS grund FROM t)"""
)
def a44_full_text(spark, sf):
    """The feed's text, the article's, or the reason why neither will do."""
    d = table(spark, sf, "documents")
    f = C.full_text(F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.col("text"), F.substring("text", 1, 900))
    return d.select("doc_id", f.alias("f")).select("doc_id", "f.herkunft", "f.grund")


@query(
    r"""WITH n AS (SELECT name, url, region, kind, row_number() OVER (PARTITION BY regexp_replace(lower(url), '/+$', '') ORDER BY name) AS r FROM quellen)
SELECT name, CASE WHEN region IN ('europe', 'asia_pacific', 'north_america', 'latin_america', 'middle_east_africa', 'global') THEN region ELSE '' END AS region, CASE WHEN kind IN ('rss', 'json_api', 'newsroom', 'newsroom_js') THEN kind ELSE 'newsroom' END AS kind, 20.0 AS frist FROM n WHERE r = 1 AND length(name) % 2 = 0
UNION ALL SELECT name, CASE WHEN region IN ('europe', 'asia_pacific', 'north_america', 'latin_america', 'middle_east_africa', 'global') THEN region ELSE '' END, CASE WHEN kind IN ('rss', 'json_api', 'newsroom', 'newsroom_js') THEN kind ELSE 'newsroom' END, coalesce((SELECT min(timeout_seconds) FROM quellen q WHERE q.name = n.name), 20.0) FROM n WHERE r = 1 AND length(name) % 2 = 1"""
)
def a45_dimension_load(spark, sf):
    """Configured sources from two lists: the first entry of an address, defaults for what is missing or unknown."""
    q = table(spark, sf, "quellen")
    watch = q.where(F.length("name") % 2 == 0).select("name", "url", "region", "kind", F.lit(None).cast("double").alias("frist"))
    both = watch.unionByName(q.where(F.length("name") % 2 == 1).select("name", "url", "region", "kind", F.col("timeout_seconds").alias("frist")))
    first = both.groupBy(U.sorted_lower(F.col("url")).alias("u")).agg(F.min_by(F.struct("name", "region", "kind", "frist"), "name").alias("r")).select("r.*")
    known = lambda c, values, default: F.when(F.col(c).isin(*values), F.col(c)).otherwise(default)
    regions = ("europe", "asia_pacific", "north_america", "latin_america", "middle_east_africa", "global")
    return first.select("name", known("region", regions, "").alias("region"), known("kind", ("rss", "json_api", "newsroom", "newsroom_js"), "newsroom").alias("kind"), F.coalesce("frist", F.lit(20.0)).alias("frist"))


@query(
    """WITH c AS (SELECT satz_nr AS o, anbieter AS name, unnest(list_distinct([anbieter] || string_split(anbieter, ' '))) AS wort FROM tarife WHERE anbieter IS NOT NULL) SELECT lower(trim(wort)) AS wort, arg_min(name, (o, name)) AS name FROM c WHERE trim(wort) != '' GROUP BY 1"""
)
def a46_synonyms(spark, sf):
    """Synonyms to the first name that claims them."""
    t = table(spark, sf, "tarife").where("anbieter is not null").select("satz_nr", "anbieter", F.split("anbieter", " ").alias("woerter"))
    return C.synonyms(t, "anbieter", "woerter", "satz_nr")


@query("SELECT zeilen_nr, titel_de, lauf FROM uebersetzungen WHERE zeilen_nr % 11 != 0")
def a48_tolerant_jsonl(spark, sf):
    """Lines of JSON of which some are cut off or blank."""
    u = table(spark, sf, "uebersetzungen").select(F.to_json(F.struct("zeilen_nr", "titel_de", "lauf")).alias("j"), "zeilen_nr")
    broken = F.when(F.col("zeilen_nr") % 11 != 0, F.col("j")).when(F.col("zeilen_nr") % 2 == 0, F.lit("  ")).otherwise(F.substring("j", 1, 12))
    path = new_folder(spark, "jsonl")
    u.select(broken.alias("value")).write.text(path)
    return C.jsonl(spark.read.text(path), "zeilen_nr bigint, titel_de string, lauf int")


@query(
    """WITH d AS (SELECT id, url, CAST(published AS DATE) AS tag, row_number() OVER (PARTITION BY url ORDER BY published DESC, id) AS r FROM items WHERE published IS NOT NULL AND url IS NOT NULL), n AS (SELECT max(tag) AS m FROM d)
SELECT id, url, tag FROM d, n WHERE r = 1 AND tag > m - 14"""
)
def a47_archive_scan(spark, sf):
    """An archive of dated reports: the last fourteen days, an address once, the newest report first."""
    i = table(spark, sf, "items").where("published is not null and url is not null").withColumn("tag", F.to_date("published"))
    path = new_folder(spark, "archiv")
    i.select("id", "url", "published", "tag").repartition("tag").write.partitionBy("tag").parquet(path)
    archive = spark.read.parquet(path)
    newest = archive.agg(F.max("tag")).first()[0]  # read from the names of the folders
    # an address counts where its newest report is; later reports all lie in the window
    last = archive.where(F.col("tag") > F.date_sub(F.lit(newest), 14)) if newest else archive
    return last.groupBy("url").agg(F.min(F.struct(-F.unix_micros(F.col("published").cast("timestamp")), F.col("id"), F.col("tag"))).alias("m")).select("m.id", "url", "m.tag")


@query(
    """WITH g AS (SELECT region, coalesce(operator, 'ohne') AS betreiber, title, row_number() OVER (PARTITION BY region, coalesce(operator, 'ohne') ORDER BY published DESC NULLS LAST, id, url, eingang_am, title) AS r, count(*) OVER (PARTITION BY region, coalesce(operator, 'ohne')) AS n FROM items WHERE title IS NOT NULL)
SELECT region, betreiber, n, string_agg('- ' || title, chr(10) ORDER BY r) FILTER (WHERE r <= 10) || CASE WHEN n > 10 THEN chr(10) || '+ ' || (n - 10) || ' weitere' ELSE '' END AS text FROM g GROUP BY region, betreiber, n"""
)
def a50_digest(spark, sf):
    """A digest per region and operator: ten titles and the number of the rest."""
    i = table(spark, sf, "items").where("title is not null").withColumn("betreiber", F.coalesce("operator", F.lit("ohne")))
    order = [F.col("published").desc_nulls_last(), F.col("id"), F.col("url"), F.col("eingang_am"), F.col("title")]
    return C.digest(i, "region", "betreiber", "title", order)


@query(
    f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM items WHERE url IS NOT NULL), k AS (SELECT DISTINCT regexp_replace(lower(regexp_replace(url, '^https?://(www\\.)?', '')), '/+$', '') AS u FROM quellen)
SELECT host, pfad, 'https://' || host || pfad AS kandidat FROM h CROSS JOIN (VALUES ('/feed'), ('/rss'), ('/rss.xml'), ('/atom.xml')) p(pfad) WHERE host || pfad NOT IN (SELECT u FROM k)"""
)
def a54_feed_candidates(spark, sf):
    """Known feed paths on every host, without those configured."""
    h = table(spark, sf, "items").where("url is not null").select(U.host(F.col("url")).alias("host")).distinct()
    c = h.withColumn("pfad", F.explode(F.array(*map(F.lit, ("/feed", "/rss", "/rss.xml", "/atom.xml"))))).withColumn("kandidat", F.concat(F.lit("https://"), "host", "pfad"))
    known = table(spark, sf, "quellen").select(U.normalize(F.lower("url")).alias("kandidat")).distinct()
    return c.join(known, "kandidat", "left_anti").select("host", "pfad", "kandidat")


@query(
    """WITH p AS (SELECT tarif_id, satz_nr, eingang_am, grundgebuehr AS neu, lag(grundgebuehr) OVER (PARTITION BY tarif_id ORDER BY eingang_am, satz_nr) AS alt FROM tarife WHERE grundgebuehr IS NOT NULL)
SELECT left(sha256('aenderung|' || tarif_id || '|' || satz_nr), 16) AS id, tarif_id || ': ' || printf('%.2f', alt) || ' -> ' || printf('%.2f', neu) AS title, eingang_am AS published, 'aenderung' AS origin FROM p WHERE alt IS NOT NULL AND alt != neu"""
)
def a22_changes_as_items(spark, sf):
    """Changes of a price as records that flow on like any other."""
    from quellwerk.operators import state

    t = table(spark, sf, "tarife").select("tarif_id", "satz_nr", "eingang_am", "grundgebuehr")
    c = state.change_points(t, ["tarif_id"], ["eingang_am", "satz_nr"], "grundgebuehr").where("vorher is not null")
    money = lambda c: F.format_string("%.2f", c)
    return c.select(F.substring(F.sha2(F.concat_ws("|", F.lit("aenderung"), "tarif_id", F.col("satz_nr").cast("string")), 256), 1, 16).alias("id"), F.concat("tarif_id", F.lit(": "), money("vorher"), F.lit(" -> "), money("grundgebuehr")).alias("title"), F.col("eingang_am").alias("published"), F.lit("aenderung").alias("origin"))


@query(
    """WITH t AS (SELECT tarif_id, anbieter || '/' || name AS schl, dokument_hash AS h, satz_nr, lag(dokument_hash) OVER (PARTITION BY tarif_id ORDER BY eingang_am, satz_nr) AS v FROM tarife WHERE dokument_hash IS NOT NULL)
SELECT satz_nr, CASE WHEN v IS NULL THEN 'neu' WHEN v = h THEN 'beruehrt' ELSE 'fassung' END AS stand FROM t"""
)
def a28_document_versions(spark, sf):
    """Documents by their hash against the last reading: new, touched or a new version."""
    from pyspark.sql import Window

    w = Window.partitionBy("tarif_id").orderBy("eingang_am", "satz_nr")
    t = table(spark, sf, "tarife").where("dokument_hash is not null").withColumn("v", F.lag("dokument_hash").over(w))
    return t.select("satz_nr", F.when(F.col("v").isNull(), "neu").when(F.col("v") == F.col("dokument_hash"), "beruehrt").otherwise("fassung").alias("stand"))

