"""Queries of the full rules: titles, claims, themes, tokens, suites, state machines with all their states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quellwerk.functions import rules as Q
from quellwerk.functions import text as T
from quellwerk.functions import urls as U
from quellwerk.operators import events as V
from quellwerk.operators import relational as R
from quellwerk.operators import state as S
from quellwerk.plans.catalog import query
from quellwerk.session import table
from quellwerk.sources import crawl as C

_KEY = ["id", "url", "eingang_am"]
_LOW = lambda c: f"lower(replace(coalesce({c}, ''), 'İ', 'i'))"
_HOST = r"regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.\-]*://', ''), '^([^/?#]*)', 1)), '^www\.', '')"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query(
    f"""WITH t AS (SELECT id, url, eingang_am, title AS rest, CASE length(title) % 5 WHEN 0 THEN 'home' WHEN 1 THEN 'share this' WHEN 2 THEN 'net net net' ELSE lower(trim(title)) END AS t FROM items)
SELECT id, url, eingang_am, trim(rest) AS titel, t IN ({_IN(Q.LABELS)}) OR (length(t) < 45 AND ({' OR '.join(f"starts_with(t, '{o}')" for o in Q.OPENINGS)})) OR t = 'net net net' OR t = '' AS leer FROM t"""
)
def a17_title_quality(spark, sf):
    """Titles that say nothing, and titles without the label and the day before them."""
    n = F.length("title") % 5
    t = F.when(n == 0, "Home").when(n == 1, "Share this").when(n == 2, "net NET net").otherwise(F.col("title"))
    dated = F.concat(F.when(n == 3, F.lit("Press release 28th May 2026 - ")).otherwise(F.lit("3. Juli 2026 ")), "title")
    return table(spark, sf, "items").select(*_KEY, Q.without_date_label(dated).alias("titel"), Q.junk_title(t).alias("leer"))


_FOLGE, _FLOSKEL = ("percent", "prozent", "procent", "ciento", "cento", "net"), ("die ", "the ", "el ")


@query(
    rf"""WITH s AS (SELECT id, url, eingang_am, {_LOW('trim(title)')} AS t FROM items) SELECT id, url, eingang_am, CASE WHEN len(list_filter(string_split_regex(t, '\s+'), lambda w: w != '')) NOT BETWEEN 4 AND 28 THEN 'laenge' WHEN length(t) - length(replace(t, '.', '')) > 2 THEN 'punkte'
  WHEN {' OR '.join(f"starts_with(t, '{w}')" for w in _FLOSKEL)} THEN 'floskel' WHEN NOT ({' OR '.join(f"contains(t, '{w}')" for w in _FOLGE)}) THEN 'ohne_folge' END AS grund FROM s"""
)
def b10_sentence_fault(spark, sf):
    """Why a sentence is refused: 4 to 28 words, two dots, no boilerplate, a consequence."""
    return table(spark, sf, "items").select(*_KEY, Q.sentence_fault(F.col("title"), _FOLGE, _FLOSKEL).alias("grund"))


@query(
    r"""WITH n AS (SELECT id, url, eingang_am, list_transform(regexp_extract_all(title, '\d+(?:[.,]\d+)?'), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)) AS a, list_transform(regexp_extract_all(coalesce(summary, ''), '\d+(?:[.,]\d+)?'), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)) AS b FROM items)
SELECT id, url, eingang_am, list_sort(list_distinct(list_filter(a, lambda x: x >= 10 AND len(list_filter(b, lambda y: abs(x - y) <= 1)) = 0))) AS ungedeckt FROM n"""
)
def b11_claims(spark, sf):
    """Numbers of a title that no number of the summary comes within one of."""
    return table(spark, sf, "items").select(*_KEY, Q.uncovered(F.col("title"), F.col("summary")).alias("ungedeckt"))


_THEMES = {"preis": ("preis", "price", "precio", "prix", "prezz", "ceny"), "netz": ("mast", "anten", " net "), "frequenz": ("frequen", "spectrum", "subasta", "veiling", "aukcja"), "tarif": (" flat ", " kompakt ", " l ", " m "), "rechenzentrum": ("rechenzentrum", "data cent", "centro de datos")}
_COUNT = lambda ws: " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in ws)
_THEME_SQL = f"""h AS (SELECT *, ' ' || regexp_replace({_LOW('title')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS t FROM items), c AS (SELECT *, {', '.join(f'{_COUNT(w)} AS n_{k}' for k, w in _THEMES.items())} FROM h),
g AS (SELECT *, greatest({', '.join(f'n_{k}' for k in _THEMES)}) AS best FROM c), th AS (SELECT id, url, eingang_am, length(title) AS laenge, CASE WHEN best = 0 OR coalesce(origin = 'tech_watch', false) OR contains(t, 'ransom') THEN NULL {' '.join(f"WHEN n_{k} = best THEN '{k}'" for k in _THEMES)} END AS thema FROM g)"""


def _themed(spark, sf):
    return table(spark, sf, "items").select(*_KEY, F.length("title").alias("laenge"), Q.argmax_theme(F.col("title"), _THEMES, F.col("origin") == "tech_watch", "ransom").alias("thema"))


@query(f"WITH {_THEME_SQL} SELECT id, url, eingang_am, thema FROM th")
def b7_themes(spark, sf):
    """The theme with most anchors; blocked categories and excluded wording have none."""
    return _themed(spark, sf).drop("laenge")


@query(f"WITH {_THEME_SQL} SELECT id, url, thema FROM th WHERE thema IS NOT NULL AND (laenge % 7 = 0 OR laenge % 6 >= 3) AND url IS NOT NULL AND url NOT IN (SELECT url FROM uebersetzungen WHERE url IS NOT NULL)")
def b8_candidates(spark, sf):
    """Records with a theme, an address not stored yet, and no relevance or one of three and more."""
    relevance = F.when(F.col("laenge") % 7 != 0, F.col("laenge") % 6)
    known = table(spark, sf, "uebersetzungen").select("url").distinct()
    return _themed(spark, sf).where("thema is not null and url is not null").where(relevance.isNull() | (relevance >= 3)).join(known, "url", "left_anti").select("id", "url", "thema")


#: subscriber: regions, origins, operators, languages (empty: all; unknown keys match nothing), keywords
_SUBS = {"alle": ((), (), (), (), ()), "europa": (("europe",), (), (), (), ("price",)), "fremd": (("atlantis",), (), (), (), ("mast",)), "genau": (("global", "europe"), ("operator",), (), ("es", "pl"), ())}


def _sub_sql(name, dims, words):
    conds = " AND ".join(f"coalesce({c} IN ({_IN(v)}), false)" for c, v in zip(("region", "origin", "operator", "sprache"), dims) if v) or "true"
    hit = " OR ".join(f"contains(t, '{w}')" for w in words) or "false"
    return f"SELECT '{name}' AS abo, id, CASE WHEN {conds} THEN 0 ELSE 1 END AS art, published FROM i WHERE ({conds}) OR ({hit})"


@query(
    f"""WITH i AS (SELECT *, {_LOW('title')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY eingang_am NULLS FIRST, url NULLS FIRST, title NULLS FIRST) AS nr FROM items WHERE id IS NOT NULL) WHERE nr = 1),
h AS ({' UNION ALL '.join(_sub_sql(k, v[:4], v[4]) for k, v in _SUBS.items())}), r AS (SELECT abo, id, art, row_number() OVER (PARTITION BY abo ORDER BY art, published DESC NULLS LAST, id) AS platz FROM h) SELECT abo, id, art, platz FROM r WHERE platz <= 8"""
)
def b14_subscriptions(spark, sf):
    """Eight entries a subscriber: those its filter takes, then those a keyword brings."""
    first = R.latest(table(spark, sf, "items").where("id is not null"), ["id"], [F.col(c).asc_nulls_first() for c in ("eingang_am", "url", "title")])
    low = T.low(F.col("title"))

    def hit(name, dims, words):
        takes = F.lit(True)
        for c, v in zip(("region", "origin", "operator", "sprache"), dims):
            takes = takes & F.coalesce(F.col(c).isin(*v), F.lit(False)) if v else takes
        word = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if words else F.lit(False)
        return F.when(takes | word, F.struct(F.lit(name).alias("abo"), F.when(takes, 0).otherwise(1).alias("art")))

    each = F.array_compact(F.array(*[hit(k, v[:4], v[4]) for k, v in _SUBS.items()]))
    rows = first.select("id", "published", F.inline(each))
    return R.top_per_group(rows, ["abo"], [F.col("art"), F.col("published").desc_nulls_last(), F.col("id")], 8, "platz").select("abo", "id", "art", "platz")


@query(
    f"""WITH a AS (SELECT * FROM items WHERE source_name IS NOT NULL), o AS (SELECT url, count(DISTINCT source_name) AS s FROM a WHERE url IS NOT NULL GROUP BY 1)
SELECT source_name, count(*) >= 5 AS genug, count(published) >= 0.8 * count(*) AS datiert, count(CASE WHEN published >= TIMESTAMP '2026-06-01' THEN 1 END) >= 3 AS frisch, count(CASE WHEN lower(trim(title)) IN ({_IN(Q.LABELS)}) THEN 1 END) <= 0.1 * count(*) AS titel,
  count(DISTINCT title) >= 0.7 * count(*) AS verschieden, count(DISTINCT {_HOST.replace('trim(url)', 'trim(a.url)')}) <= 2 AS domaene, count(DISTINCT a.url) >= 0.9 * count(a.url) AS adressen, count(CASE WHEN s > 1 THEN 1 END) < 0.6 * count(*) AS eigen FROM a LEFT JOIN o ON a.url = o.url GROUP BY source_name"""
)
def b22_eight_criteria(spark, sf):
    """Eight expectations of a source's records."""
    i = table(spark, sf, "items").where("source_name is not null")
    shared = i.where("url is not null").groupBy("url").agg(F.count_distinct("source_name").alias("s"))
    label = F.lower(F.trim("title")).isin(*Q.LABELS)
    n = F.count("*")
    return i.join(shared, "url", "left").groupBy("source_name").agg(
        (n >= 5).alias("genug"), (F.count("published") >= 0.8 * n).alias("datiert"), (F.count_if(F.col("published") >= F.expr("timestamp_ntz'2026-06-01'")) >= 3).alias("frisch"), (F.count_if(label) <= 0.1 * n).alias("titel"),
        (F.count_distinct("title") >= 0.7 * n).alias("verschieden"), (F.count_distinct(U.host(F.col("url"))) <= 2).alias("domaene"), (F.count_distinct("url") >= 0.9 * F.count("url")).alias("adressen"), (F.count_if(F.col("s") > 1) < 0.6 * n).alias("eigen"),
    )


_NAME = "trim(regexp_replace(lower(replace(operator, 'İ', 'i')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(
    rf"""WITH o AS (SELECT {_NAME} AS p, min(operator) AS name FROM items WHERE operator IS NOT NULL GROUP BY 1), k AS (SELECT * FROM o WHERE length(p) >= 3 AND (contains(p, ' ') OR length(p) >= 8)),
i AS (SELECT DISTINCT id, url, operator, title, ' ' || trim(regexp_replace({_LOW('title')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS t FROM items WHERE origin = 'industry_news' AND title IS NOT NULL),
m AS (SELECT i.id, i.url, i.title, k.name, len(string_split(k.p, ' ')) AS w, strpos(i.t, ' ' || k.p || ' ') AS stelle FROM i JOIN k ON contains(i.t, ' ' || k.p || ' ')), b AS (SELECT id, url, title, name FROM (SELECT *, row_number() OVER (PARTITION BY id, url, title ORDER BY w DESC, stelle, name DESC) AS r FROM m) WHERE r = 1)
SELECT DISTINCT i.id, i.url, coalesce(b.name, i.operator, 'ohne') AS betreiber FROM i LEFT JOIN b ON b.id = i.id AND b.url IS NOT DISTINCT FROM i.url AND b.title = i.title"""
)
def c2_operator_names(spark, sf):
    """The longest operator a headline of trade news names; short single words are ambiguous and name nobody; others keep their own."""
    i = table(spark, sf, "items").where("origin = 'industry_news' and title is not null").select("id", "url", "operator", "title").distinct()
    form = F.array_join(F.filter(F.split(T.low(F.col("operator")), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    names = table(spark, sf, "items").where("operator is not null").select("operator", form.alias("p")).where("length(p) >= 3 and (contains(p, ' ') or length(p) >= 8)").select("operator").distinct()
    found = V.recognised(V.mentions(i, F.struct("id", "url", "title"), F.col("title"), names, "operator"), ("\u0000",))
    hit = found.select(F.col("k.id").alias("id2"), F.col("k.url").alias("url2"), F.col("k.title").alias("title2"), "name")
    j = i.join(hit, (F.col("id") == F.col("id2")) & F.col("url").eqNullSafe(F.col("url2")) & (F.col("title") == F.col("title2")), "left")
    return j.select("id", "url", F.coalesce("name", "operator", F.lit("ohne")).alias("betreiber")).distinct()


@query(
    """WITH r AS (SELECT url, min(id) AS kopf FROM items WHERE url IS NOT NULL AND id IS NOT NULL GROUP BY 1), i AS (SELECT DISTINCT id, url, region FROM items WHERE url IS NOT NULL AND id IS NOT NULL),
g AS (SELECT DISTINCT lower(item_id) AS kopf FROM uebersetzungen WHERE item_id IS NOT NULL) SELECT i.id, i.url, i.region FROM i JOIN r USING (url) LEFT JOIN g ON g.kopf = r.kopf WHERE g.kopf IS NULL OR coalesce(i.region NOT IN ('europe', 'global'), true)"""
)
def c5_unread(spark, sf):
    """Records whose representative was not read, or whose region was not processed."""
    i = table(spark, sf, "items").where("url is not null and id is not null").select("id", "url", "region").distinct()
    heads = i.groupBy("url").agg(F.min("id").alias("kopf"))
    read = table(spark, sf, "uebersetzungen").where("item_id is not null").select(F.lower("item_id").alias("kopf"), F.lit(True).alias("gelesen")).distinct()
    j = i.join(heads, "url").join(read, "kopf", "left")
    return j.where(F.col("gelesen").isNull() | ~F.coalesce(F.col("region").isin("europe", "global"), F.lit(False))).select("id", "url", "region")


@query(
    """WITH t AS (SELECT DISTINCT source_name AS thema, url FROM items WHERE url IS NOT NULL AND source_name IS NOT NULL AND length(title) % 3 != 0), k AS (SELECT DISTINCT region || '/' || source_name AS kandidat, url FROM items WHERE url IS NOT NULL AND source_name IS NOT NULL AND region IS NOT NULL),
n AS (SELECT kandidat, count(*) AS n FROM k GROUP BY 1) SELECT k.kandidat, t.thema, count(*) AS gemeinsam FROM k JOIN t USING (url) JOIN n USING (kandidat) GROUP BY 1, 2, n.n HAVING count(*) >= 0.6 * n.n"""
)
def c24_contained(spark, sf):
    """Candidates of which at least three fifths of the addresses are in a topic already."""
    i = table(spark, sf, "items").where("url is not null and source_name is not null")
    topic = i.where("length(title) % 3 != 0").select(F.col("source_name").alias("thema"), "url").distinct()
    cand = i.where("region is not null").select(F.concat_ws("/", "region", "source_name").alias("kandidat"), "url").distinct()
    size = cand.groupBy("kandidat").agg(F.count("*").alias("n"))
    g = cand.join(topic, "url").groupBy("kandidat", "thema").agg(F.count("*").alias("gemeinsam")).join(size, "kandidat")
    return g.where(F.col("gemeinsam") >= 0.6 * F.col("n")).select("kandidat", "thema", "gemeinsam")


@query(
    """WITH i AS (SELECT DISTINCT id, lower(trim(title)) AS titel, source_name FROM items WHERE title IS NOT NULL AND id IS NOT NULL), r AS (SELECT titel, min(id) AS kopf, count(*) AS mitglieder, count(DISTINCT source_name) AS quellen FROM i GROUP BY 1) SELECT kopf, titel, mitglieder, quellen FROM r WHERE mitglieder > 1"""
)
def c27_evidence_lists(spark, sf):
    """Groups of records of one title: head, members, senders."""
    i = table(spark, sf, "items").where("title is not null and id is not null").select("id", F.lower(F.trim("title")).alias("titel"), "source_name").distinct()
    g = i.groupBy("titel").agg(F.min("id").alias("kopf"), F.count("*").alias("mitglieder"), F.count_distinct("source_name").alias("quellen"))
    return g.where("mitglieder > 1").select("kopf", "titel", "mitglieder", "quellen")


@query(
    """WITH i AS (SELECT DISTINCT id, region, published, length(title) % 6 AS relevanz FROM items WHERE id IS NOT NULL AND region IS NOT NULL AND title IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY relevanz DESC, published DESC NULLS LAST, id) AS runde FROM i)
SELECT region, id, runde FROM (SELECT *, row_number() OVER (ORDER BY runde, relevanz DESC, region) AS platz FROM f WHERE runde <= 5) WHERE platz <= 18"""
)
def e2_budget_over_regions(spark, sf):
    """Five per region by relevance, dealt round by round until a budget of eighteen is spent."""
    i = table(spark, sf, "items").where("id is not null and region is not null and title is not null").select("id", "region", "published", (F.length("title") % 6).alias("relevanz")).distinct()
    top = R.top_per_group(i, ["region"], [F.col("relevanz").desc(), F.col("published").desc_nulls_last(), F.col("id")], 5, "runde")
    return top.orderBy("runde", F.col("relevanz").desc(), "region").limit(18).select("region", "id", "runde")


@query(
    r"""WITH i AS (SELECT DISTINCT id, source_name, title, length(title) % 4 AS ctm, length(title) % 6 AS relevanz FROM items WHERE id IS NOT NULL AND source_name IS NOT NULL AND title IS NOT NULL),
g AS (SELECT * FROM i WHERE len(list_filter(string_split_regex(trim(title), '\s+'), lambda w: w != '')) <= 20 AND regexp_matches(title, '\d')), s AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY ctm DESC, relevanz DESC, id, title) AS r FROM g)
SELECT source_name, id FROM (SELECT *, row_number() OVER (ORDER BY ctm DESC, relevanz DESC, id, title) AS platz FROM s WHERE r = 1) WHERE platz <= 12"""
)
def e4_gated_one_per_sender(spark, sf):
    """The best twelve with one per sender, of titles up to twenty words that give a number."""
    words = F.size(F.filter(F.split(F.trim("title"), r"\s+"), lambda w: w != ""))
    i = table(spark, sf, "items").where("id is not null and source_name is not null and title is not null").where((words <= 20) & F.col("title").rlike(r"\d"))
    i = i.select("id", "source_name", "title", (F.length("title") % 4).alias("ctm"), (F.length("title") % 6).alias("relevanz")).distinct()
    order = [F.col("ctm").desc(), F.col("relevanz").desc(), F.col("id"), F.col("title")]
    return R.top_per_group(i, ["source_name"], order, 1).orderBy(*order).limit(12).select("source_name", "id")


@query(
    """WITH i AS (SELECT DISTINCT id, region, published, left(CASE WHEN length(coalesce(volltext, '')) > length(coalesce(summary, '')) THEN volltext ELSE coalesce(summary, '') END, 2500) AS text FROM items WHERE id IS NOT NULL AND region IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY published DESC NULLS LAST, id, text) AS platz FROM i) SELECT region, id, CASE WHEN platz <= 60 THEN (platz - 1) // 15 END AS stapel, length(text) AS zeichen, platz > 60 AS ungelesen FROM r"""
)
def f7_batches(spark, sf):
    """Sixty a region in batches of fifteen, with the longer of text and teaser; the rest is reported unread."""
    longer = F.when(F.length(F.coalesce("volltext", F.lit(""))) > F.length(F.coalesce("summary", F.lit(""))), F.col("volltext")).otherwise(F.coalesce("summary", F.lit("")))
    i = table(spark, sf, "items").where("id is not null and region is not null").select("id", "region", "published", F.substring(longer, 1, 2500).alias("text")).distinct()
    top = R.top_per_group(i, ["region"], [F.col("published").desc_nulls_last(), F.col("id"), F.col("text")], 60, "platz")
    rest = i.join(top.select("id", "region", "published", "text"), on=[i[c].eqNullSafe(top[c]) for c in ("id", "region", "published", "text")], how="left_anti")
    done = top.select("region", "id", F.floor((F.col("platz") - 1) / 15).cast("bigint").alias("stapel"), F.length("text").alias("zeichen"), F.lit(False).alias("ungelesen"))
    return done.union(rest.select("region", "id", F.lit(None).cast("bigint"), F.length("text"), F.lit(True)))


@query(r"SELECT id, eingang_am, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://', ''), '^www\.', ''), '/+$', '') AS form FROM items")
def h2_schemeless(spark, sf):
    return table(spark, sf, "items").select("id", "eingang_am", Q.schemeless(F.col("url")).alias("form"))


_PLAIN_W = "list_filter(string_split_regex(t, '[^a-z0-9äöüß]+'), lambda w: w != '')"
_NO_STOP = lambda n: f"list_filter({_PLAIN_W}, lambda w: length(w) >= {n} AND w NOT IN ({_IN(Q.STOP)}))"


@query(
    rf"""WITH h AS (SELECT id, url, eingang_am, {_LOW('title')} AS t FROM items) SELECT id, url, eingang_am, list_distinct(list_filter(list_transform(list_filter(string_split_regex(t, '[^a-z0-9äöüß-]+'), lambda w: w != ''), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: length(w) >= 4)).list_sort() AS lang,
  list_sort(list_distinct(list_transform({_NO_STOP(3)}, lambda w: regexp_replace(w, '^(.{{4,}}?)(?:en|es|er|s)$', '\1')))) AS stamm, list_sort({_NO_STOP(2)}) AS beutel, list_sort(list_distinct({_NO_STOP(3)})) AS drei,
  list_sort(list_distinct(list_filter(string_split_regex(t, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 4))) AS wort, list_sort(list_distinct({_NO_STOP(4)})) AS vier FROM h"""
)
def h5_six_tokenizers(spark, sf):
    return table(spark, sf, "items").select(*_KEY, *[F.array_sort(c).alias(k) for k, c in Q.tokenizers(F.col("title")).items()])


@query(
    rf"""WITH f AS (SELECT id, url, eingang_am, list_transform(regexp_extract_all({_LOW("title || ' ' || coalesce(summary, '')")}, '\d+(?:[.,]\d+)?\s*(?:gbit/s|mbit/s|ghz|mhz|gb|tb|€|euro|eur|%|prozent|percent|procent|millisekunden|ms)?'),
  lambda x: {{'n': replace(regexp_extract(x, '^(\d+(?:[.,]\d+)?)', 1), ',', '.'), 'u': CASE regexp_extract(x, '\d\s*([^\d\s.,].*)?$', 1) WHEN 'euro' THEN '€' WHEN 'eur' THEN '€' WHEN 'prozent' THEN '%' WHEN 'percent' THEN '%' WHEN 'procent' THEN '%' WHEN 'millisekunden' THEN 'ms' ELSE regexp_extract(x, '\d\s*([^\d\s.,].*)?$', 1) END}}) AS p FROM items)
SELECT id, url, eingang_am, list_sort(list_distinct(list_transform(list_filter(p, lambda x: x.u != '' OR (contains(x.n, '.') OR length(x.n) >= 4) AND NOT regexp_full_match(x.n, '19\d\d|20\d\d|2100')), lambda x: x.n || x.u))) AS zahlen FROM f"""
)
def h6_numbers_with_units(spark, sf):
    """Numbers with their unit in one spelling."""
    return table(spark, sf, "items").select(*_KEY, Q.salient(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))).alias("zahlen"))


@query(f"WITH h AS (SELECT id, eingang_am, {_HOST.replace('trim(url)', 'trim(u)')} AS h FROM (SELECT id, eingang_am, CASE WHEN length(title) % 2 = 0 THEN replace(url, '.example', '.co.uk') ELSE url END AS u FROM items)) SELECT id, eingang_am, CASE WHEN h LIKE '%.co.uk' THEN regexp_extract(h, '([^.]+\\.co\\.uk)$', 1) ELSE regexp_extract(h, '([^.]+\\.[^.]+)$', 1) END AS seite FROM h")
def h29_site(spark, sf):
    """Registrable domains, public suffixes of two labels included."""
    url = F.when(F.length("title") % 2 == 0, F.replace("url", F.lit(".example"), F.lit(".co.uk"))).otherwise(F.col("url"))
    return table(spark, sf, "items").select("id", "eingang_am", Q.site(url, C.SUFFIXES).alias("seite"))


@query(
    """WITH e AS (SELECT user_id, event_id, ts, event_type IN ('error', 'view') AS f FROM events), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS insel FROM e),
s AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, insel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS serie FROM g)
SELECT event_id, CAST(serie AS BIGINT) AS serie, serie >= 6 AS quarantaene, serie > 6 AND (serie - 6) % 10 = 0 AS probe FROM s"""
)
def i5_quarantine_with_probes(spark, sf):
    """Six failures in a row lead to quarantine, every tenth run in it is a probe, a success ends it."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    s = S.failure_streaks(e, "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view"))
    n = F.col("fehlserie")
    return s.select("event_id", n.cast("bigint").alias("serie"), (n >= 6).alias("quarantaene"), ((n > 6) & ((n - 6) % 10 == 0)).alias("probe"))


@query(
    """WITH r AS (SELECT tarif_id, satz_nr, eingang_am, grundgebuehr, speed_down_max FROM tarife), k AS (SELECT tarif_id, eingang_am, count(*) AS n FROM tarife GROUP BY 1, 2)
SELECT r.tarif_id, first(grundgebuehr ORDER BY r.eingang_am, satz_nr) FILTER (WHERE grundgebuehr IS NOT NULL) AS erstpreis, last(grundgebuehr ORDER BY r.eingang_am, satz_nr) FILTER (WHERE grundgebuehr IS NOT NULL) AS preis, last(speed_down_max ORDER BY r.eingang_am, satz_nr) FILTER (WHERE speed_down_max IS NOT NULL) AS rate,
  (SELECT count(*) FROM k WHERE k.tarif_id = r.tarif_id AND n > 1) AS kollisionen FROM r GROUP BY r.tarif_id"""
)
def i6_upsert_with_collisions(spark, sf):
    """First and last known values, a missing one never overwrites; rows of one key at one moment are reported."""
    t = table(spark, sf, "tarife")
    at = F.struct("eingang_am", "satz_nr")
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    twice = t.groupBy("tarif_id", "eingang_am").agg(F.count("*").alias("n")).groupBy("tarif_id").agg(F.count_if(F.col("n") > 1).alias("kollisionen"))
    g = t.groupBy("tarif_id").agg(F.min_by("grundgebuehr", known("grundgebuehr")).alias("erstpreis"), F.max_by("grundgebuehr", known("grundgebuehr")).alias("preis"), F.max_by("speed_down_max", known("speed_down_max")).alias("rate"))
    return g.join(twice, "tarif_id").select("tarif_id", "erstpreis", "preis", "rate", "kollisionen")


@query(
    """WITH s AS (SELECT tarif_id, anbieter, max(CAST(eingang_am AS DATE)) AS zuletzt FROM tarife WHERE anbieter IS NOT NULL GROUP BY 1, 2), v AS (SELECT anbieter, tag FROM (SELECT anbieter, CAST(eingang_am AS DATE) AS tag, count(*) AS n FROM tarife WHERE anbieter IS NOT NULL GROUP BY 1, 2) WHERE n >= 2)
SELECT s.tarif_id, s.anbieter, least(count(v.tag), 2) AS stufe FROM s LEFT JOIN v ON v.anbieter = s.anbieter AND v.tag > s.zuletzt GROUP BY 1, 2"""
)
def i7_ageing_by_full_pages(spark, sf):
    """Active, supposed gone, delisted: one step a day, and only on days when the provider's page was read whole (here: two rows and more)."""
    t = table(spark, sf, "tarife").where("anbieter is not null").withColumn("tag", F.to_date("eingang_am"))
    whole = t.groupBy("anbieter", "tag").agg(F.count("*").alias("n")).where("n >= 2").select("anbieter", "tag")
    # later whole days of a provider as a running count, so tariffs meet one number instead of all days
    w = Window.partitionBy("anbieter").orderBy(F.col("tag").desc())
    seen = t.groupBy("tarif_id", "anbieter").agg(F.max("tag").alias("zuletzt"))
    marks = whole.select("anbieter", "tag", F.row_number().over(w).alias("ab"))
    later = seen.join(marks, "anbieter", "left").where("tag is null or tag > zuletzt").groupBy("tarif_id", "anbieter").agg(F.max("ab").alias("ab"))
    return seen.join(later, ["tarif_id", "anbieter"], "left").select("tarif_id", "anbieter", F.least(F.coalesce("ab", F.lit(0)), F.lit(2)).alias("stufe"))


@query(
    """WITH p AS (SELECT DISTINCT CAST(ts AS DATE) AS tag, user_id % 7 AS segment, user_id FROM events WHERE event_type IN ('view', 'click')), l AS (SELECT CAST(ts AS DATE) AS tag, user_id, max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 2 ELSE 1 END) AS s FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1, 2)
SELECT p.tag, p.segment, p.user_id, CASE WHEN s IS NULL THEN 'neu' ELSE 'nochmal' END AS art FROM p LEFT JOIN l USING (tag, user_id) WHERE coalesce(s, 0) < 2"""
)
def i17_delivery_with_retries(spark, sf):
    """A plan against the log: confirmed and refused deliveries are done, failed ones are tried again."""
    e = table(spark, sf, "events").withColumn("tag", F.to_date("ts"))
    plan = e.where(F.col("event_type").isin("view", "click")).select("tag", (F.col("user_id") % 7).alias("segment"), "user_id").distinct()
    done = F.max(F.when(F.col("event_type").isin("purchase", "signup"), 2).otherwise(1)).alias("s")
    log = e.where(F.col("event_type").isin("purchase", "signup", "error")).groupBy("tag", "user_id").agg(done)
    return plan.join(log, ["tag", "user_id"], "left").where("coalesce(s, 0) < 2").select("tag", "segment", "user_id", F.when(F.col("s").isNull(), "neu").otherwise("nochmal").alias("art"))


@query(
    """WITH g AS (SELECT user_id, count(CASE WHEN event_type = 'error' AND value > 80 THEN 1 END) AS hart, count(CASE WHEN event_type = 'error' AND value <= 80 THEN 1 END) AS weich, max(ts) AS stand FROM events GROUP BY 1)
SELECT user_id, hart, weich, hart > 0 OR weich >= 5 AS gesperrt, stand FROM g"""
)
def i19_bounce_fold(spark, sf):
    """A hard event blocks at once, five soft ones do; the latest time is the mark from which the next run reads."""
    bad = F.col("event_type") == "error"
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(bad & (F.col("value") > 80)).alias("hart"), F.count_if(bad & (F.col("value") <= 80)).alias("weich"), F.max("ts").alias("stand"))
    return g.select("user_id", "hart", "weich", ((F.col("hart") > 0) | (F.col("weich") >= 5)).alias("gesperrt"), "stand")


@query(
    """WITH w AS (SELECT anbieter, CASE WHEN eingang_am < TIMESTAMP '2026-01-01' THEN 0 ELSE 1 END AS lauf, tarif_id || '|' || printf('%.2f', grundgebuehr) AS wert FROM tarife WHERE anbieter IS NOT NULL AND tarif_id IS NOT NULL AND grundgebuehr IS NOT NULL),
d AS (SELECT DISTINCT * FROM w), n AS (SELECT anbieter, count(CASE WHEN lauf = 0 THEN 1 END) AS alt, count(CASE WHEN lauf = 1 THEN 1 END) AS neu FROM d GROUP BY 1), x AS (SELECT anbieter, count(*) AS anders FROM (SELECT anbieter, wert FROM d GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1)
SELECT n.anbieter, CASE WHEN neu < 2 THEN 'zu wenig' WHEN alt = 0 THEN 'erststand' WHEN coalesce(anders, 0) > 12 THEN 'umbau' WHEN coalesce(anders, 0) > 0 THEN 'aenderung' ELSE 'gleich' END AS stand FROM n LEFT JOIN x USING (anbieter)"""
)
def a20_change_states(spark, sf):
    """A page's values against the last run: too few to judge, first sight, redesign (over twelve differences), change or none."""
    t = table(spark, sf, "tarife").where("anbieter is not null and tarif_id is not null and grundgebuehr is not null")
    w = t.select("anbieter", (F.col("eingang_am") >= F.expr("timestamp_ntz'2026-01-01'")).alias("neu"), F.concat_ws("|", "tarif_id", F.format_string("%.2f", "grundgebuehr")).alias("wert"))
    v = w.groupBy("anbieter", "wert").agg(F.max((~F.col("neu")).cast("int")).alias("o"), F.max(F.col("neu").cast("int")).alias("n"))
    g = v.groupBy("anbieter").agg(F.sum("o").alias("alt"), F.sum("n").alias("neu"), F.count_if(F.col("o") != F.col("n")).alias("anders"))
    return g.select("anbieter", F.when(F.col("neu") < 2, "zu wenig").when(F.col("alt") == 0, "erststand").when(F.col("anders") > 12, "umbau").when(F.col("anders") > 0, "aenderung").otherwise("gleich").alias("stand"))
