"""Queries of predicates, validators and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellwerk.functions import checks as K
from quellwerk.functions import text as T
from quellwerk.functions import urls as U
from quellwerk.plans.catalog import query
from quellwerk.session import table

_KEY = ["id", "url", "eingang_am"]
_LOW = lambda c: f"lower(replace(coalesce({c}, ''), 'İ', 'i'))"
_HOST = r"regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.\-]*://', ''), '^([^/?#]*)', 1)), '^www\.', '')"


@query("SELECT id, url, title, published, ctm FROM (SELECT id, url, title, published, length(title) % 4 AS ctm FROM items)")
def b3_round_trip(spark, sf):
    """Records written as JSON with ISO times and read back."""
    i = table(spark, sf, "items").select(F.to_json(F.struct("id", "url", "title", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("published"), (F.length("title") % 4).alias("ctm"))).alias("j"))
    r = i.select(F.from_json("j", "id string, url string, title string, published string, ctm int").alias("r")).select("r.*")
    return r.withColumn("published", F.col("published").cast("timestamp_ntz"))


@query(f"SELECT id, url, eingang_am FROM items WHERE NOT coalesce(source_name LIKE 'V%', false) AND NOT coalesce({_HOST} LIKE '%-kurier.example', false)")
def b5_blocked_senders(spark, sf):
    """Records whose sender and domain are not blocked."""
    i = table(spark, sf, "items")
    blocked = F.coalesce(F.col("source_name").startswith("V"), F.lit(False)) | F.coalesce(U.host(F.col("url")).endswith("-kurier.example"), F.lit(False))
    return i.where(~blocked).select(*_KEY)


@query(rf"SELECT doc_id, array_to_string(list_filter(string_split_regex(coalesce(text, ''), '\n\s*\n'), lambda p: NOT regexp_matches({_LOW('p')}, 'percent|prozent|por ciento') AND NOT regexp_full_match(p, '[\s\p{{Z}}]*')), chr(10) || chr(10)) AS text FROM documents")
def b5_without_paragraphs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.without_paragraphs(F.col("text"), "percent|prozent|por ciento").alias("text"))


_CATEGORY = {"operator": "netz", "industry_news": "markt", "tech_watch": "technik"}
_TAGS = {"5g": ("5g",), "preis": ("preis", "price", "precio", "prix", "prezz", "ceny"), "frequenz": ("frequen", "spectrum", "subasta", "aukcja"), "netz": ("mast", "anten", "ghz")}
_TAG_SQL = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {w!r})' for w in ws)} THEN '{k}' END" for k, ws in _TAGS.items()) + "], lambda x: x IS NOT NULL))"


@query(
    f"""SELECT id, url, eingang_am, CASE WHEN contains(t, 'satel') THEN 'satellit' WHEN origin = 'operator' THEN 'netz' WHEN origin = 'industry_news' THEN 'markt' WHEN origin = 'tech_watch' THEN 'technik' ELSE 'sonstiges' END AS ressort, {_TAG_SQL} AS marken
FROM (SELECT *, {_LOW("title || ' ' || coalesce(summary, '')")} AS t FROM items)"""
)
def b6_category_and_tags(spark, sf):
    """A keyword beats the category map; several technical labels by substring."""
    text = F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in _CATEGORY.items() for x in kv]), F.col("origin"))
    category = F.when(F.contains(T.low(text), F.lit("satel")), "satellit").otherwise(F.coalesce(known, F.lit("sonstiges")))
    return table(spark, sf, "items").select(*_KEY, category.alias("ressort"), K.tags(text, _TAGS).alias("marken"))


@query(
    r"""WITH n AS (SELECT id, url, eingang_am, list_transform(regexp_extract_all(title, '\d+(?:[.,]\d+)?'), lambda n: regexp_replace(regexp_replace(replace(n, ',', '.'), '(\.\d*?)0+$', '\1'), '\.$', '')) AS a,
  list_transform(regexp_extract_all(coalesce(summary, '') || ' ' || coalesce(volltext, ''), '\d+(?:[.,]\d+)?'), lambda n: regexp_replace(regexp_replace(replace(n, ',', '.'), '(\.\d*?)0+$', '\1'), '\.$', '')) AS b FROM items)
SELECT id, url, eingang_am, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS gedeckt FROM n"""
)
def b13_numbers_allowed(spark, sf):
    """Titles whose every number stands in the summary or the full text."""
    allowed = K.all_numbers(F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("volltext", F.lit(""))))
    return table(spark, sf, "items").select(*_KEY, K.numbers_allowed(F.col("title"), allowed).alias("gedeckt"))


@query(
    r"""WITH w AS (SELECT DISTINCT wort FROM (SELECT unnest(string_split(title, ' ')) AS wort FROM items)) SELECT wort, CASE WHEN length(trim(wort)) < 4 THEN 'kurz' WHEN length(trim(wort)) > 60 THEN 'lang' WHEN NOT regexp_matches(wort, '\p{L}') THEN 'leer' END AS fehler FROM w"""
)
def b15_keyword_faults(spark, sf):
    """Words a reader might ask for, and why a filter refuses them."""
    w = table(spark, sf, "items").select(F.explode(F.split("title", " ")).alias("wort")).distinct()
    return w.select("wort", K.keyword_fault(F.col("wort")).alias("fehler"))


_SIGNS = {"preis": (("preis", "price", "precio"), ()), "ausbau": (("mast", "antenn", "anten"), ("net", "mobil")), "verkauf": (("5g", "flat"), ("fibra",))}
_SIGN_SQL = "(VALUES " + ", ".join(f"('{k}', {list(w)}, {list(b) or '[]::VARCHAR[]'})" for k, (w, b) in _SIGNS.items()) + ") AS s(zeichen, woerter, marken)"


@query(
    f"""WITH i AS (SELECT strftime(published, '%Y-%m') AS monat, {_LOW('title')} AS t, {_LOW("coalesce(operator, '') || ' ' || title")} AS b FROM items WHERE published IS NOT NULL), m AS (SELECT max(monat) AS neu FROM i),
h AS (SELECT zeichen, monat FROM i, {_SIGN_SQL} WHERE len(list_filter(woerter, lambda w: contains(t, w))) > 0 AND (len(marken) = 0 OR len(list_filter(marken, lambda w: contains(b, w))) > 0))
SELECT s.zeichen, CASE WHEN count(CASE WHEN monat = neu THEN 1 END) > 0 THEN 'aktiv' WHEN count(CASE WHEN monat >= strftime(CAST(neu || '-01' AS DATE) - INTERVAL 2 MONTH, '%Y-%m') THEN 1 END) > 0 THEN 'beobachtet' ELSE 'ruhend' END AS stand, count(monat) AS treffer
FROM {_SIGN_SQL} LEFT JOIN h ON h.zeichen = s.zeichen CROSS JOIN m GROUP BY s.zeichen"""
)
def b16_indicators(spark, sf):
    """Signs that need a keyword and, where named, a brand; active in the newest month, watched in the two before."""
    i = table(spark, sf, "items").where("published is not null").select(F.date_format("published", "yyyy-MM").alias("monat"), T.low(F.col("title")).alias("t"), T.low(F.concat_ws(" ", F.coalesce("operator", F.lit("")), "title")).alias("b"))
    any_of = lambda c, ws: F.greatest(*[F.contains(F.col(c), F.lit(w)) for w in ws], F.lit(False))
    hit = F.array_compact(F.array(*[F.when(any_of("t", w) & (any_of("b", b) if b else F.lit(True)), F.lit(k)) for k, (w, b) in _SIGNS.items()]))
    months = i.select("monat", F.explode(hit).alias("zeichen")).groupBy("zeichen", "monat").agg(F.count("*").alias("n"))
    newest = i.agg(F.max("monat")).first()[0] or "0001-01"
    before = F.date_format(F.add_months(F.to_date(F.lit(f"{newest}-01")), -2), "yyyy-MM")
    every = spark.createDataFrame([(k,) for k in _SIGNS], "zeichen string")
    g = every.join(months, "zeichen", "left").groupBy("zeichen").agg(F.max("monat").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("treffer"))
    return g.select("zeichen", F.when(F.col("m") == newest, "aktiv").when(F.col("m") >= before, "beobachtet").otherwise("ruhend").alias("stand"), "treffer")


_KEYWORDS = ("price", "preis", "spectrum", "mast", "net", "5g", "mobil")


@query(
    f"""SELECT doc_id, treffer FROM (SELECT doc_id, {' + '.join(f"CASE WHEN regexp_matches({_LOW('text')}, '(?:^|[^\\p{{L}}\\p{{N}}]){w}') THEN 1 ELSE 0 END" for w in _KEYWORDS)} AS treffer FROM documents) WHERE treffer >= 2"""
)
def b17_two_keywords(spark, sf):
    """Documents in which at least two different keywords begin a word."""
    return table(spark, sf, "documents").select("doc_id", K.keyword_hits(F.col("text"), _KEYWORDS).alias("treffer")).where("treffer >= 2")


@query(
    rf"""SELECT id, url, eingang_am, array_to_string(list_filter(string_split(regexp_replace(trim(coalesce(summary, '')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) != '' AND NOT regexp_matches({_LOW('s')}, 'percent|prozent|procent|ciento')), ' ') AS text FROM items"""
)
def b18_without_sentences(spark, sf):
    """Summaries without the sentences that give a share."""
    return table(spark, sf, "items").select(*_KEY, K.without_sentences(F.col("summary"), "percent|prozent|procent|ciento").alias("text"))


@query(
    rf"""WITH m AS (SELECT id, url, eingang_am, CASE WHEN length(title) % 2 = 0 THEN '## Lage' || chr(10) ELSE '' END || title || chr(10) || chr(10) || '## Folgen' || chr(10) || coalesce(summary, '') || CASE WHEN length(title) % 3 = 0 THEN ' [mehr](' || url || ')' ELSE '' END AS md FROM items WHERE url IS NOT NULL)
SELECT id, url, eingang_am, list_sort(list_filter([CASE WHEN NOT starts_with(md, '## Lage') THEN 'fehlt:Lage' END, CASE WHEN contains({_LOW('md')}, 'prozent') THEN 'verboten:prozent' END, CASE WHEN NOT regexp_matches({_LOW('md')}, '\]\(https?://') THEN 'kein_link' END,
  CASE WHEN list_max(list_transform(string_split_regex(md, '\n\s*\n'), lambda p: length(p))) > 120 THEN 'absatz_zu_lang' END], lambda x: x IS NOT NULL)) AS fehler FROM m"""
)
def b19_briefing_faults(spark, sf):
    """Briefings with missing headings, forbidden phrases, no link or long paragraphs."""
    n = F.length("title")
    md = F.concat(F.when(n % 2 == 0, F.lit("## Lage\n")).otherwise(F.lit("")), F.col("title"), F.lit("\n\n## Folgen\n"), F.coalesce("summary", F.lit("")), F.when(n % 3 == 0, F.concat(F.lit(" [mehr]("), F.col("url"), F.lit(")"))).otherwise(F.lit("")))
    i = table(spark, sf, "items").where("url is not null").select(*_KEY, md.alias("md"))
    return i.select(*_KEY, K.briefing_faults(F.col("md"), ("Lage", "Folgen"), ("prozent",), 120).alias("fehler"))


_SIGNALS = (r"\d+ ?(?:€|eur)", r"\d+ ?gb", r"\d+ ?ghz", r"5g", r"%|percent|prozent|procent|ciento", r"20\d\d", r"\d+,\d+", r"\d{3,}", r"net(?:[^\p{L}\p{N}]|$)", r"mobil")


@query(
    f"""SELECT doc_id, laenge, signale, laenge >= 200 AND signale >= 4 AS angenommen FROM (SELECT doc_id, length(coalesce(text, '')) AS laenge, {' + '.join(f"CASE WHEN regexp_matches({_LOW('text')}, '{p}') THEN 1 ELSE 0 END" for p in _SIGNALS)} AS signale FROM documents)"""
)
def b23_page_acceptance(spark, sf):
    """Pages long enough with at least four of ten signals."""
    low = T.low(F.coalesce("text", F.lit("")))
    signals = sum((low.rlike(p).cast("int") for p in _SIGNALS), F.lit(0))
    d = table(spark, sf, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("laenge"), signals.alias("signale"))
    return d.withColumn("angenommen", (F.col("laenge") >= 200) & (F.col("signale") >= 4))


@query(f"""SELECT id, url, eingang_am FROM items WHERE contains({_LOW("coalesce(operator, '') || ' ' || coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(source_name, '')")}, 'net') AND region = 'europe' AND length(title) % 6 >= 2""")
def b24_explorer_filter(spark, sf):
    """A word in any of four fields, a region, a least relevance."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("operator", "title", "summary", "source_name")])
    return table(spark, sf, "items").where(F.contains(T.low(text), F.lit("net")) & (F.col("region") == "europe") & (F.length("title") % 6 >= 2)).select(*_KEY)


@query(
    """SELECT satz_nr, list_sort(list_filter([CASE WHEN NOT coalesce(grundgebuehr > 20, false) THEN 'grundgebuehr' END, CASE WHEN name IS NULL OR name = '' OR length(name) > 300 THEN 'name' END], lambda x: x IS NOT NULL)) AS ohne_beleg FROM tarife"""
)
def b25_provenance(spark, sf):
    """Fields whose evidence line is not in the raw text; here it prints fees above 20 only."""
    fee = F.format_string("%.2f", "grundgebuehr")
    raw = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.when(F.col("grundgebuehr") > 20, F.concat(F.lit("kostet "), fee)).otherwise(F.lit("-")))
    evidence = F.create_map(F.lit("grundgebuehr"), F.concat(F.lit("kostet "), fee), F.lit("name"), F.col("name"))
    return table(spark, sf, "tarife").select("satz_nr", K.unproven(evidence, raw).alias("ohne_beleg"))


@query("SELECT satz_nr, tarif_id FROM (SELECT satz_nr, tarif_id, datenvolumen_gb AS v, max(CASE WHEN datenvolumen_gb IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY tarif_id) AS hat FROM tarife) WHERE v IS NOT NULL OR hat = 0")
def b27_without_containers(spark, sf):
    """Rows without a volume go where the same tariff has rows with one."""
    t = table(spark, sf, "tarife")
    has = t.where("datenvolumen_gb is not null").select("tarif_id").distinct()
    return t.where("datenvolumen_gb is not null").select("satz_nr", "tarif_id").union(t.where("datenvolumen_gb is null").join(has, "tarif_id", "left_anti").select("satz_nr", "tarif_id"))


@query(
    """SELECT id, coalesce(operator, 'ohne') AS absender, CASE WHEN length(title) <= 40 THEN title ELSE left(title, 39) || '…' END AS kurz, CASE WHEN length(title) * 37 % 900 + 200 >= 600 THEN image_url END AS bild FROM items"""
)
def b28_view_projection(spark, sf):
    """Renamed, defaulted and shortened columns; small images are left out."""
    wide = F.length("title") * 37 % 900 + 200 >= 600
    short = F.when(F.length("title") <= 40, F.col("title")).otherwise(F.concat(F.substring("title", 1, 39), F.lit("…")))
    return table(spark, sf, "items").select("id", F.coalesce("operator", F.lit("ohne")).alias("absender"), short.alias("kurz"), F.when(wide, F.col("image_url")).alias("bild"))


@query("SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS nr FROM orders WHERE o_orderstatus IN ('O', 'P') QUALIFY nr <= 25")
def b29_status_filter(spark, sf):
    """Open entries in a fixed order, the first twenty-five of each state."""
    from quellwerk.operators.relational import top_per_group

    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return top_per_group(o, ["o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")], 25, "nr").select("o_orderstatus", "o_orderkey", "nr")


@query("SELECT name, kind IN ('rss', 'json_api', 'newsroom') AND abgenommen IS NOT NULL AS lesbar, herkunft != 'Hinweis' AS gezaehlt FROM quellen")
def b30_eligibility(spark, sf):
    """Sources that may be read and sources that count."""
    q = table(spark, sf, "quellen")
    return q.select("name", (F.col("kind").isin("rss", "json_api", "newsroom") & F.col("abgenommen").isNotNull()).alias("lesbar"), (F.col("herkunft") != "Hinweis").alias("gezaehlt"))


@query(
    """SELECT id, url, eingang_am, title AS kurzfassung, CASE WHEN length(title) % 2 = 0 THEN coalesce(trim(summary), '') END AS themen FROM (SELECT id, url, eingang_am, trim(title) AS title, summary FROM items)"""
)
def b31_marked_sections(spark, sf):
    """A text with marked sections, parted at its marks; a mark that is not there gives null."""
    text = F.concat(F.lit("Vorrede ===KURZFASSUNG===\n"), F.trim("title"), F.when(F.length(F.trim("title")) % 2 == 0, F.concat(F.lit("\n===THEMEN===\n"), F.coalesce(F.trim("summary"), F.lit("")))).otherwise(F.lit("")))
    i = table(spark, sf, "items").select(*_KEY, text.alias("t"))
    return i.select(*_KEY, K.section(F.col("t"), "KURZFASSUNG").alias("kurzfassung"), K.section(F.col("t"), "THEMEN").alias("themen"))


@query(rf"SELECT id, url, eingang_am, length(q) >= 8 AND contains(t, q) AS belegt FROM (SELECT id, url, eingang_am, trim(regexp_replace({_LOW('left(summary, 30)')}, '\s+', ' ', 'g')) AS q, trim(regexp_replace({_LOW('CASE WHEN length(title) % 2 = 0 THEN summary ELSE title END')}, '\s+', ' ', 'g')) AS t FROM items)")
def h23_quote_held(spark, sf):
    """Is the opening of the summary, as a quote, literally in the text?"""
    text = F.when(F.length("title") % 2 == 0, F.col("summary")).otherwise(F.col("title"))
    return table(spark, sf, "items").select(*_KEY, K.quoted_in(F.substring("summary", 1, 30), text).alias("belegt"))


_PEPPER = "pfeffer"
_PAD = ["".join(f"{b ^ p:02x}" for b in _PEPPER.encode().ljust(64, b"\0")) for p in (0x36, 0x5C)]
_HMAC = lambda m: f"sha256(from_hex('{_PAD[1]}') || from_hex(sha256(from_hex('{_PAD[0]}') || encode({m}))))"


@query(f"SELECT c_custkey, {_HMAC('lower(trim(c_name))')} AS kennwert, lower(trim(replace(c_name, '#', '.'))) || '@example.org' AS adresse FROM customer")
def h18_pseudonyms(spark, sf):
    """HMAC of a folded name, and a checked address."""
    address = K.mail_address(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.org ")))
    return table(spark, sf, "customer").select("c_custkey", K.hmac_sha256(_PEPPER, F.lower(F.trim("c_name"))).alias("kennwert"), address.alias("adresse"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND 1000 - c_custkey % 100 * 10 <= 600 THEN CAST(c_custkey AS VARCHAR) END AS daten FROM customer")
def h19_signed_tokens(spark, sf):
    """Tokens of which some are old, forged or made for something else; the data of those that hold."""
    kind = F.col("c_custkey") % 4
    token = K.signed_token("geheim", F.when(kind == 1, F.lit("abmelden")).otherwise(F.lit("bestaetigen")), F.col("c_custkey").cast("string"), F.lit(9000) + F.col("c_custkey") % 100 * 10)
    token = F.when(kind == 2, F.concat(F.substring_index(token, ".", 3), F.lit(".0123"))).when(kind == 3, F.regexp_replace(token, r"^bestaetigen\.\d+", "bestaetigen.1")).otherwise(token)
    return table(spark, sf, "customer").select("c_custkey", token.alias("t")).select("c_custkey", K.token_data("geheim", "bestaetigen", F.col("t"), F.lit(10000), 600).alias("daten"))


@query(
    """WITH h AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), p AS (SELECT p_partkey, p_retailprice AS v, floor(log10(greatest(p_retailprice, 1.0)) + 1e-12) AS e FROM part)
SELECT p_partkey, CASE WHEN greatest(v, 1.0) <= pow(10.0, e) THEN pow(10.0, e) WHEN greatest(v, 1.0) <= 2 * pow(10.0, e) THEN 2 * pow(10.0, e) WHEN greatest(v, 1.0) <= 5 * pow(10.0, e) THEN 5 * pow(10.0, e) ELSE 10 * pow(10.0, e) END AS achse, round((v - lo) / (hi - lo) * 640, 4) AS x FROM p, h"""
)
def h26_chart_geometry(spark, sf):
    """The top of an axis and the place of every value on it."""
    p = table(spark, sf, "part")
    low, high = p.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()  # one row
    return p.select("p_partkey", K.axis_top(F.col("p_retailprice")).alias("achse"), F.round(K.projected(F.col("p_retailprice"), F.lit(low), F.lit(high), 640.0), 4).alias("x"))


@query("SELECT id, url, eingang_am, CASE WHEN regexp_matches(trim(k), '^\\d{1,9}$') AND CAST(trim(k) AS INT) < len(w) THEN w[CAST(trim(k) AS INT) + 1] END AS wort FROM (SELECT id, url, eingang_am, string_split(title, ' ') AS w, CASE length(title) % 4 WHEN 0 THEN ' 2 ' WHEN 1 THEN '-1' WHEN 2 THEN '99' ELSE 'x' END AS k FROM items)")
def j4_defensive_index(spark, sf):
    """An index that may be wrong, out of range or no number."""
    k = F.when(F.length("title") % 4 == 0, " 2 ").when(F.length("title") % 4 == 1, "-1").when(F.length("title") % 4 == 2, "99").otherwise("x")
    return table(spark, sf, "items").select(*_KEY, K.element_or_null(F.split("title", " "), k).alias("wort"))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in K.GERMAN_MONTHS) + "]"


@query(f"SELECT id, url, eingang_am, day(published) || '.' || month(published) || '.' || year(published) AS tag, {_MONTHS}[month(published)] || ' ' || year(published) AS monat, {_HOST} AS seite FROM items WHERE published IS NOT NULL")
def j7_labels(spark, sf):
    """Labels of days, months and sites for rendering."""
    return table(spark, sf, "items").where("published is not null").select(*_KEY, K.day_label(F.col("published")).alias("tag"), K.month_label(F.col("published")).alias("monat"), U.host(F.col("url")).alias("seite"))


@query("SELECT id, CASE WHEN operator IS NOT NULL THEN operator ELSE coalesce(region, 'global') END AS anker, coalesce(nullif(region, ''), 'global') AS bereich, length(title) % 4 * 10 + length(url) % 6 AS gewicht FROM items")
def h28_entries(spark, sf):
    """Records as entries with an anchor, a region with a default and a weight."""
    return table(spark, sf, "items").select("id", F.coalesce("operator", "region", F.lit("global")).alias("anker"), F.coalesce(F.nullif("region", F.lit("")), F.lit("global")).alias("bereich"), (F.length("title") % 4 * 10 + F.length("url") % 6).alias("gewicht"))


@query("SELECT id, url, eingang_am, CASE WHEN titel != '' AND NOT ends_with(titel, '…') THEN titel WHEN kurz != '' THEN kurz ELSE titel END AS schlagzeile FROM (SELECT id, url, eingang_am, trim(CASE WHEN length(title) % 2 = 0 THEN left(title, 20) || '…' ELSE title END) AS titel, trim(coalesce(summary, '')) AS kurz FROM items)")
def h11_display_text(spark, sf):
    """The title unless it is cut off, else the summary."""
    title = F.trim(F.when(F.length("title") % 2 == 0, F.concat(F.substring("title", 1, 20), F.lit("…"))).otherwise(F.col("title")))
    short = F.trim(F.coalesce("summary", F.lit("")))
    return table(spark, sf, "items").select(*_KEY, F.when((title != "") & ~title.endswith("…"), title).when(short != "", short).otherwise(title).alias("schlagzeile"))

