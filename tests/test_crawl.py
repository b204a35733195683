"""Parsers and rules of the crawl on broken, empty and odd input."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quellwerk.functions import checks as K
from quellwerk.functions import dates as DT
from quellwerk.functions import extract as X
from quellwerk.functions import fields as FD
from quellwerk.functions import rules as Q
from quellwerk.functions.text import first_object
from quellwerk.sources import crawl as C
from quellwerk.sources import documents as D
from quellwerk.sources import fetch as W


def _all(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", column(F.col("v")).alias("x"))
    return [r.x for r in df.orderBy("i").collect()]


def test_malformed_feeds():
    entry = "<item><title>A &amp; B</title><link>https://x.example/?a=1&amp;b=2</link><pubDate>x</pubDate></item>"
    want = {"titel": "A & B", "url": "https://x.example/?a=1&b=2"}
    for raw in (f"<rss><channel>{entry}</channel></rss>", f"<rss><channel><copyright>C & D</copyright>{entry}</channel></rss>", f"<rss><channel>{entry}", f"\x00<rss><channel>{entry}<item><title>cut"):
        got = D.feed_entries(raw)
        assert [{k: e[k] for k in want} for e in got] == [want], raw
    assert D.feed_entries(None) == D.feed_entries("") == D.feed_entries("no feed") == []
    media = D.feed_media('<rss><item><link>u</link><description>&lt;img src="i.png"&gt; text</description></item></rss>')
    assert media == [{"url": "u", "bild": "i.png", "volltext": None}]


def test_json_newest_first_and_first_object():
    raw = '[{"title":"old","url":"a","date":"2026-01-01"},{"title":"new","url":"b","date":"2026-02-01"},{"title":"none","url":"c"}]'
    assert [e["titel"] for e in D.json_entries(raw)] == ["new", "old", "none"]
    assert first_object('a {broken} then {"k": {"x": "}"}} and {"l": 2}') == '{"k": {"x": "}"}}'
    assert first_object(None) is None and first_object("none { here") is None


def test_adapters_and_pages():
    with pytest.raises(ValueError):
        C.register("rss", lambda raw: [])
    assert C.attribute_entries(None) == C.attribute_entries("<p data-x='{broken'>") == []
    assert C.schema_delivery('<script type="application/ld+json">{broken</script>') == []
    page = C.page_candidates('<h2>Kopf</h2><a href="/a#b">eins</a><a href="https://other.example/">x</a><img src="k.png">', "https://x.example/")
    assert page[0]["links"] == [{"url": "https://x.example/a", "text": "eins", "ueber": "Kopf"}] and page[0]["bilder"] == [{"url": "https://x.example/k.png", "link": None}]
    assert C.document_links('<a href="/t.pdf">T</a><a href="/t.pdf">U</a>', "https://x.example/", r"\.pdf$") == [{"url": "https://x.example/t.pdf", "titel": "T"}]


def test_days(spark):
    days = ["2026-02-30", "Stand 3.7.2026", "14 de julio de 2026", "July 4th, 2026", "4 Foo 2026", "1er août 2026", "20260704", "1783123200", "", None]
    assert [str(x) for x in _all(spark, DT.any_day, days)] == ["None", "2026-07-03", "2026-07-14", "2026-07-04", "None", "2026-08-01", "2026-07-04", "2026-07-04", "None", "None"]
    assert [x and (str(x.tag), x.genau) for x in _all(spark, DT.path_day, ["/2026/07/04/x", "/2026/7/", "/2026/13/", None])] == [("2026-07-04", True), ("2026-07-01", False), None, None]


def test_delivery_context(spark):
    got = _all(spark, X.delivery_days, ["24 Tage Laufzeit", "Widerruf binnen 14 Tagen", "Versand dauert 4 bis 6 Wochen", "Rabatt 20 %. Lieferung in 10 Tagen", ""])
    assert [tuple(x) if x else None for x in got] == [None, None, ("wartezeit", 28, 42), ("wartezeit", 10, 10), None]


def test_hmac_and_tokens(spark):
    words = ["", "abc", "ü" * 200]
    for key in ("k", "l" * 80):
        assert _all(spark, lambda c: K.hmac_sha256(key, c), words) == [hmac.new(key.encode(), w.encode(), hashlib.sha256).hexdigest() for w in words]
    token = lambda c: K.token_data("k", "x", K.signed_token("k", F.lit("x"), c, F.lit(100)), F.lit(150), 60, 10)
    assert _all(spark, token, ["abc", "a.b"]) == ["abc", None]
    assert _all(spark, K.mail_address, [" A@B.org ", "a@b", "a b@c.de", None]) == ["a@b.org", None, None, None]


def test_checks_on_empty_texts(spark):
    texts = [None, "", "   "]
    assert _all(spark, lambda c: F.size(K.sentences(c)), texts) == [0, 0, 0]
    assert _all(spark, lambda c: K.keyword_hits(c, ("a",)), texts) == [0, 0, 0]
    assert _all(spark, lambda c: K.briefing_faults(c, ("A",), ("b",), 10), [None]) == [["fehlt:A", "kein_link"]]
    assert _all(spark, lambda c: K.element_or_null(F.array(F.lit("x")), c), ["0", "1", "-1", "99999999999", "a", None]) == ["x", None, None, None, None, None]
    assert _all(spark, Q.junk_title, ["Home", "net net", "", "Ein Titel", "Share this with everyone you know, and with all of their friends"]) == [True, True, True, False, False]
    assert _all(spark, lambda c: Q.cut_text(c, 2, 12), ["Eins. Zwei. Drei.", "Ein sehr langer Satz ohne Ende.", "", None]) == ["Eins. Zwei.", "Ein sehr…", "", None]


def test_staircase_and_names(spark):
    sheet = "                Monat 1-6       ab Monat 7\nGrundpreis      1.019,95 €      29,95 €\n"
    assert [[(x.kategorie, x.preis) for x in r] for r in _all(spark, C.staircase, [sheet])] == [[("Monat 1-6", 1019.95), ("ab Monat 7", 29.95)]]
    assert _all(spark, C.certificate_name, ["*.A.Example.", "a", None, "a b.c"]) == ["a.example", None, None, None]
    assert _all(spark, C.parent_site, ["m.x.example", "x.co.uk", "example"]) == ["x.example", "x.co.uk", "example"]


def test_fetch_policy():
    now = [0.0]

    def sleep(s):
        now[0] += s

    def run(answers, deadline=75.0, quick=False):
        now[0], left, names = 0.0, list(answers), []

        def get(url, headers, timeout):
            names.append(headers["User-Agent"])
            a = left.pop(0)
            if a is OSError:
                raise OSError
            return a, "x"

        return W.attempt("u", get, deadline, 20, quick, sleep, lambda: now[0])[0::1], names

    assert run([200])[0] == (200, "x", 1, None)
    (status, body, tries, why), names = run([403, 200])
    assert (status, tries, why) == (200, 2, None) and names == list(W.AGENTS)
    assert run([503, OSError, 200])[0] == (200, "x", 3, None) and now[0] == 13.0
    assert run([503, 503, 503])[0][2:] == (3, "fehler")
    assert run([503, 200], deadline=3.0)[0][2:] == (1, "frist")
    assert run([503], quick=True)[0][2:] == (1, "fehler")
    assert W.attempt(None, None, 1, 1, False, sleep, lambda: 0)[3] == "keine Adresse"


def test_safe_html_and_json(spark):
    assert W.safe_html("## A <b>\n\n*x* **y** [z](http://a.b/?q=1&r=2) [bad](javascript:1)") == '<h2>A &lt;b&gt;</h2><p><em>x</em> <strong>y</strong> <a href="http://a.b/?q=1&amp;r=2">z</a> [bad](javascript:1)</p>'
    assert W.safe_html(None) == ""
    assert _all(spark, W.script_safe, ['{"a": "</script>&\u2028"}']) == ['{"a": "\\u003c/script\\u003e\\u0026\\u2028"}']
    assert _all(spark, lambda c: W.document(F.encode(c, "UTF-8"), F.lit(None).cast("string")), [None]) == [None]


def test_fields_of_nulls_and_odd_text(spark):
    assert _all(spark, FD.price, ["1.234,56 €", "1,234.56", "0", "10.000,01", "x", None]) == [1234.56, 1234.56, None, None, None, None]
    assert _all(spark, FD.availability, ["https://schema.org/PreOrder", "soldout", "", None]) == ["vorbestellbar", "ausverkauft", "unbekannt", None]
    assert _all(spark, lambda c: FD.longest_word(c, FD.COLOURS), ["in Midnight Black", "Blaubeere", None]) == ["midnight black", None, None]
    assert _all(spark, lambda c: FD.gaps(a=c, b=F.lit(1.0)), [None, float("nan"), 2.0], "double") == [["a"], ["a"], []]
