import datetime as dt

from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.functions import urls as U
from quellwerk.sources import documents as D
from quellwerk.sources import tariff_text


def _one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).collect()[0].x


def test_addresses(spark):
    assert _one(spark, U.normalize, "http://WWW.Site.de/A/b/?utm_source=x&id=3&ref=t&b=2#top") == "https://site.de/A/b?id=3&b=2"
    assert _one(spark, U.normalize, None) is None
    assert _one(spark, U.sorted_lower, "https://Site.de/X?b=2&a=1") == "site.de/x?a=1&b=2"
    assert _one(spark, U.registrable, "https://a.b.site.de/x") == "site.de"
    assert str(_one(spark, U.path_date, "https://s.de/2026/07/03/x")) == "2026-07-03"
    assert str(_one(spark, U.path_date, "https://s.de/2026/07/x")) == "2026-07-01"
    assert _one(spark, U.path_date, "https://s.de/2026/02/31/x") is None


def test_texts(spark):
    assert _one(spark, T.slug, "Große  Übung 5G!") == "grosse-uebung-5g"
    assert _one(spark, T.numbers, "3,5 von 2026 bis 12") == ["12", "3.5"]
    assert [_one(spark, T.german_decimal, x) for x in ("1.234,56", "1,234.56", "12", "12,5 €", "x", None)] == [1234.56, 1234.56, 12.0, 12.5, None, None]
    assert _one(spark, lambda c: T.truncated(c, 10), "eins zwei drei vier") == "eins zwei…"
    assert _one(spark, T.first_sentence, "Es war. Dann nicht.") == "Es war."
    assert _one(spark, T.visible, "<nav>weg</nav><p>a &amp; b</p><script>x</script>") == "a & b"
    assert _one(spark, T.json_block, "```json\n{\"a\": 1}\n```") == '{"a": 1}'
    assert _one(spark, T.stem, "Masten") == "Mast"


def test_feed_json_links_products_robots(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>https://s.de/1</link><description>&lt;b&gt;Text&lt;/b&gt;</description></item><item><title>ohne</title></item></channel></rss>"
    assert [(e["titel"], e["url"], e["text"]) for e in D.feed_entries(rss)] == [("A & B", "https://s.de/1", "Text")]
    assert D.feed_entries("<rss><item>") == D.feed_entries(None) == []
    doc = '{"x": {"list": [{"headline": {"rendered": "<b>T</b>"}, "link": "u"}, {"headline": "T"}]}}'
    assert [(e["titel"], e["url"]) for e in D.json_entries(doc)] == [("T", "u")]
    assert D.json_entries("kein json") == []
    page = '<nav><a href="/m">Ein sehr langer Eintrag im Menü hier</a></nav><a href="/a#x">Ein Titel, der lang genug ist dafür</a><a href="https://fremd.org/x">Ein Titel, der lang genug ist dafür</a>'
    assert [x["url"] for x in D.page_links(page, "https://www.s.de/")] == ["https://www.s.de/a"]
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"P","offers":{"price":"9.99"},"isSimilarTo":[{"@type":"Product","name":"Q","offers":[{"price":5}]}]}]}</script>'
    assert {(p["name"], p["preis"]) for p in D.page_products(ld)} == {("P", "9.99"), ("Q", "5")}
    rules = D.robots_rules("User-agent: *\nDisallow: /a\nAllow: /a/b\nUser-agent: x\nDisallow: /")
    assert [D.robots_allows(rules, p) for p in ("/a/c", "/a/b/d", "/z")] == [False, True, True]


def test_tariff_sheet(spark):
    text = "Vertragslaufzeit: vierundzwanzig Monate\nGrundgebühr: 1.234,50 €\nDatenvolumen unbegrenzt\nDownload bis 1 Gbit/s"
    r = tariff_text.extract(spark.createDataFrame([(text,), (None,), ("",)], "t string"), "t").collect()
    assert (r[0].laufzeit_monate, r[0].grundgebuehr, r[0].datenvolumen_gb, r[0].download_mbit) == (24, 1234.5, float("inf"), 1000.0)
    assert r[0].beleg_preis == "Grundgebühr: 1.234,50 €" and r[1].grundgebuehr is None and r[2].laufzeit_monate is None
    assert _one(spark, tariff_text.values, "nur 5 GB und  5 GB, 10 Euro") == ["10 €", "nur 5 gb", "und 5 gb"]


def test_age(spark):
    from quellwerk.operators import relational as R

    now = dt.datetime(2026, 1, 10)
    rows = spark.createDataFrame([(1, None), (2, now), (3, now - dt.timedelta(days=9)), (4, now + dt.timedelta(days=3))], "i int, p timestamp")
    assert sorted(r.i for r in R.fresh(rows, "p", F.lit(now), 8).collect()) == [1, 2]
