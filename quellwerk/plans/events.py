"""Queries of events: actors, pair verdicts, memory, evidence, names in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.operators import events as V
from quellwerk.operators import relational as R
from quellwerk.plans.catalog import query
from quellwerk.session import materialise, table

_LOW = lambda c: f"lower(replace({c}, 'İ', 'i'))"
_STOP = ", ".join(f"'{x}'" for x in V.NO_ACTOR)
_STEM = r"regexp_replace(w, '^(.{4,}?)(?:en|es|er|s)$', '\1')"
_ACTORS = rf"""list_sort(list_distinct(list_transform(list_filter(list_transform(list_concat(regexp_extract_all(title, '\p{{Lu}}[\p{{L}}\p{{N}}]{{2,}}'), list_filter(string_split_regex(coalesce(operator, ''), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2)),
  lambda w: {_LOW('w')}), lambda w: w NOT IN ({_STOP})), lambda w: {_STEM})))"""
_WORDS = f"list_distinct(list_filter(string_split_regex({_LOW('title')}, '[^a-z0-9äöüß]+'), lambda w: length(w) >= 4))"
_NUMBERS = r"list_distinct(list_filter(list_transform(regexp_extract_all(title, '\d+(?:[.,]\d+)?'), lambda n: replace(n, ',', '.')), lambda n: NOT regexp_full_match(n, '19\d\d|20\d\d|2100')))"
_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY eingang_am NULLS FIRST, url NULLS FIRST, title NULLS FIRST) AS nr FROM items WHERE id IS NOT NULL) WHERE nr = 1)"
_TOLD = f"t AS (SELECT id, operator, published AS zeit, {_WORDS} AS w, {_ACTORS} AS akteure, {_NUMBERS} AS z FROM {_FIRST} WHERE published IS NOT NULL)"
_PAIRS = """p AS (SELECT a.id AS a, b.id AS b, a.zeit AS za, b.zeit AS zb, a.operator AS oa, b.operator AS ob, coalesce(len(list_intersect(a.w, b.w)) / nullif(least(len(a.w), len(b.w)), 0), 0) AS s, len(list_intersect(a.z, b.z)) > 0 AS n, len(list_intersect(a.akteure, b.akteure)) AS g
FROM (SELECT DISTINCT x.id AS ia, y.id AS ib FROM (SELECT id, unnest(akteure) AS k FROM t) x JOIN (SELECT id, unnest(akteure) AS k FROM t) y ON x.k = y.k AND x.id != y.id) m JOIN t a ON a.id = m.ia JOIN t b ON b.id = m.ib WHERE b.zeit <= a.zeit AND date_diff('second', b.zeit, a.zeit) <= 259200)"""
_VERDICT = "CASE WHEN coalesce(oa != ob, false) THEN 'verschieden' WHEN s >= 0.5 OR n AND s >= 0.16 THEN 'gleich' WHEN s >= 0.12 THEN 'grau' ELSE 'verschieden' END"


def _told(spark, sf, which: str = "true"):
    first = R.latest(table(spark, sf, "items").where("id is not null"), ["id"], [F.col(c).asc_nulls_first() for c in ("eingang_am", "url", "title")])
    return V.described(first.where(which), "id", "title", "operator", "published")


@query(f"SELECT id, url, eingang_am, {_ACTORS} AS akteure FROM items")
def h7_actors(spark, sf):
    """Stems of the capitalised words and of the operator, without words that name nobody."""
    return table(spark, sf, "items").select("id", "url", "eingang_am", V.actors(F.col("title"), F.col("operator")).alias("akteure"))


@query(f"WITH {_TOLD}, {_PAIRS} SELECT a, b, round(s, 6) AS aehnlich, n AS gemeinsame_zahl, {_VERDICT} AS urteil FROM p")
def c7_pair_verdict(spark, sf):
    """All pairs within 72 hours that share an actor, judged."""
    return V.judged(_told(spark, sf)).select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), "aehnlich", "gemeinsame_zahl", "urteil")


@query(f"WITH {_TOLD}, {_PAIRS} SELECT a, b, round(s + CASE WHEN n THEN 0.25 ELSE 0 END + 0.1 * (g - 1), 6) AS rang FROM p WHERE {_VERDICT} = 'grau'")
def h24_grey_priority(spark, sf):
    """Doubtful pairs by how much speaks for them."""
    t = _told(spark, sf)
    return V.verdict(V.near_pairs(t, t)).where("urteil = 'grau'").select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), "rang")


@query(
    f"""WITH f AS {_FIRST}, {_TOLD}, {_PAIRS}, h AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY zb, b) AS r FROM p WHERE {_VERDICT} = 'gleich' AND a IN (SELECT id FROM f WHERE origin != 'operator') AND b IN (SELECT id FROM f WHERE origin = 'operator'))
SELECT a AS id, b AS ereignis FROM h WHERE r = 1"""
)
def c10_event_memory(spark, sf):
    """Reports by others that continue an event an operator told of."""
    hit = V.remembered(_told(spark, sf, "origin != 'operator'"), _told(spark, sf, "origin = 'operator'"))
    return hit.select(F.col("k").alias("id"), "ereignis")


@query(
    f"""WITH {_TOLD}, {_PAIRS}, f AS (SELECT a, min(zb) AS seit FROM p WHERE {_VERDICT} = 'gleich' GROUP BY a)
SELECT CAST(zeit AS DATE) AS tag, count(*) AS meldungen, count(f.a) AS folgen FROM t LEFT JOIN f ON f.a = t.id GROUP BY 1"""
)
def i4_follow_ups(spark, sf):
    """Per day: records, and those that attach to an event of the last 72 hours and are not reported again."""
    t = materialise(_told(spark, sf), "told")
    hit = V.attached(t).withColumn("folgt", F.lit(True))
    g = t.select("k", F.to_date("zeit").alias("tag")).join(V.apart(hit), "k", "left").groupBy("tag")
    return g.agg(F.count("*").alias("meldungen"), F.count("folgt").alias("folgen"))


@query(
    f"""WITH i AS (SELECT * FROM {_FIRST} WHERE published IS NOT NULL), r AS (SELECT CAST(published AS DATE) AS tag, id AS k, {_WORDS} AS w FROM i),
s AS (SELECT tag, satz, list_distinct(list_filter(string_split_regex({_LOW('satz')}, '[^a-z0-9äöüß]+'), lambda w: length(w) >= 4)) AS w FROM (SELECT DISTINCT CAST(published AS DATE) AS tag, summary AS satz FROM i WHERE summary IS NOT NULL AND summary != '')),
u AS (SELECT tag, k, unnest(w) AS w FROM r), n AS (SELECT tag, count(*) AS n FROM r GROUP BY 1), d AS (SELECT u.tag, u.w, count(*) AS df FROM u GROUP BY 1, 2),
q AS (SELECT d.* FROM d JOIN n USING (tag) WHERE df <= greatest(2, n // 8)), m AS (SELECT s2.tag, s2.satz, u.k, count(*) AS c, round(sum(1.0 / q.df), 6) AS gewicht FROM (SELECT tag, satz, unnest(w) AS w FROM s) s2 JOIN q ON q.tag = s2.tag AND q.w = s2.w JOIN u ON u.tag = q.tag AND u.w = q.w GROUP BY 1, 2, 3 HAVING count(*) >= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY tag, k ORDER BY gewicht DESC, satz DESC) AS r1 FROM m), e AS (SELECT *, row_number() OVER (PARTITION BY tag, satz ORDER BY gewicht DESC, k) AS r2 FROM o WHERE r1 = 1)
SELECT tag, satz, k, gewicht FROM e WHERE r2 <= 4"""
)
def c20_evidence(spark, sf):
    """Records that support the sentences of a day's summaries."""
    first = R.latest(table(spark, sf, "items").where("id is not null"), ["id"], [F.col(c).asc_nulls_first() for c in ("eingang_am", "url", "title")]).where("published is not null")
    day = F.to_date("published").alias("tag")
    records = first.select(day, F.col("id").alias("k"), T.tokens(F.col("title"), 4).alias("woerter"))
    told = first.where("summary is not null and summary != ''").select(day, F.col("summary").alias("satz")).distinct()
    return V.evidence(told.withColumn("woerter", T.tokens(F.col("satz"), 4)), records)


_TEXT = "trim(regexp_replace(lower(replace(title || ' ' || coalesce(summary, ''), 'İ', 'i')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_NAME = "trim(regexp_replace(lower(replace(operator, 'İ', 'i')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(
    f"""WITH o AS (SELECT {_NAME} AS p, min(operator) AS name FROM items WHERE operator IS NOT NULL GROUP BY 1), i AS (SELECT id, url, published, {_TEXT} AS t FROM items WHERE url IS NOT NULL AND title IS NOT NULL),
m AS (SELECT DISTINCT o.name, i.url, i.published FROM i JOIN o ON p != '' AND contains(' ' || t || ' ', ' ' || p || ' ')), f AS (SELECT name, url, max(published) AS published FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY published DESC NULLS LAST, url) AS platz FROM f) SELECT name, url, published, platz FROM r WHERE platz <= 16"""
)
def c13_competitor_items(spark, sf):
    """The newest sixteen addresses whose title or summary names an operator."""
    i = table(spark, sf, "items").where("url is not null and title is not null")
    names = table(spark, sf, "items").select("operator").distinct()
    found = V.mentions(i, F.struct("url", "published"), F.concat_ws(" ", "title", F.coalesce("summary", F.lit(""))), names, "operator")
    each = found.groupBy("name", F.col("k.url").alias("url")).agg(F.max("k.published").alias("published"))
    top = R.top_per_group(each, ["name"], [F.col("published").desc_nulls_last(), F.col("url").asc()], 16)
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy(F.col("published").desc_nulls_last(), "url")
    return top.select("name", "url", "published", F.row_number().over(w).cast("bigint").alias("platz"))


@query(
    rf"""WITH k AS (SELECT DISTINCT {_NAME} AS p, split_part({_NAME}, ' ', 1) AS marke FROM items WHERE operator IS NOT NULL), i AS (SELECT url, eingang_am, {_NAME} AS feld, trim(regexp_replace({_LOW('title')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t FROM items WHERE url IS NOT NULL),
u AS (SELECT DISTINCT split_part(feld, ' ', 1) AS marke, url, eingang_am FROM i WHERE feld IS NOT NULL UNION SELECT k.marke, i.url, i.eingang_am FROM i JOIN k ON i.feld IS NULL AND p != '' AND contains(' ' || t || ' ', ' ' || p || ' '))
SELECT marke, url, min(eingang_am) AS zuerst FROM u WHERE marke != '' GROUP BY 1, 2"""
)
def c14_brand_chronicle(spark, sf):
    """Addresses per brand, by the operator field where there is one, else by the title; the first arrival of each."""
    i = table(spark, sf, "items").where("url is not null")
    form = F.array_join(F.filter(F.split(T.low(F.col("operator")), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    brand = lambda c: F.substring_index(c, " ", 1)
    field = i.where("operator is not null").select(brand(form).alias("marke"), "url", "eingang_am")
    names = i.where("operator is not null").select(form.alias("operator")).distinct()
    found = V.mentions(i.where("operator is null and title is not null"), F.struct("url", "eingang_am"), F.col("title"), names, "operator")
    both = field.union(found.select(brand(F.col("name")).alias("marke"), "k.url", "k.eingang_am"))
    return both.where("marke != ''").groupBy("marke", "url").agg(F.min("eingang_am").alias("zuerst"))


@query(
    rf"""WITH n AS (SELECT p, min(name) AS name FROM (SELECT {_NAME} AS p, operator AS name FROM items WHERE operator IS NOT NULL) WHERE p != '' AND len(string_split(p, ' ')) <= 4 GROUP BY p),
i AS (SELECT DISTINCT id, url, ' ' || trim(regexp_replace({_LOW('title')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS t FROM items WHERE title IS NOT NULL),
m AS (SELECT i.id, i.url, i.t, n.name, len(string_split(p, ' ')) AS k, s.start, list_extract(string_split(trim(t), ' '), s.start + len(string_split(p, ' '))) AS danach FROM i JOIN n ON contains(t, ' ' || p || ' ')
  CROSS JOIN LATERAL (SELECT unnest(list_filter(range(1, len(string_split(trim(t), ' ')) + 1), lambda x: list_slice(string_split(trim(t), ' '), x, x + len(string_split(p, ' ')) - 1) = string_split(p, ' '))) AS start) s)
SELECT id, url, name FROM (SELECT *, row_number() OVER (PARTITION BY id, url, t ORDER BY k DESC, start, name DESC) AS r FROM m WHERE danach IS NULL OR danach NOT IN ('net', 'fibra', 'mobil')) WHERE r = 1"""
)
def b20_recognised_names(spark, sf):
    """The longest operator a title names, unless a word follows that makes it another one."""
    i = table(spark, sf, "items").where("title is not null").select("id", "url", "title").distinct()
    names = table(spark, sf, "items").select("operator").distinct()
    low = F.array_join(F.filter(F.split(T.low(F.col("title")), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    found = V.mentions(i.withColumn("t", low), F.struct("id", "url", "t"), F.col("title"), names, "operator")
    return V.recognised(found, ("net", "fibra", "mobil")).select("k.id", "k.url", "name")

