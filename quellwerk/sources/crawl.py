"""What a crawl reads from pages, logs and files: parsers, and rules on their columns.

Parsers take one document and give lists of records; a broken document gives an
empty list.  ``ADAPTERS`` maps a kind of source to its parser, and others can be
registered.  Rules are Column -> Column.
"""

from __future__ import annotations

import html as html_entities
import json
import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellwerk.functions import urls as U
from quellwerk.sources import documents as D

RECORD = "struct<titel:string,url:string,datum:string,text:string,bild:string>"
ADAPTERS: dict[str, Callable[[str | None], list[dict]]] = {"rss": D.feed_entries, "json_api": D.json_entries}


def register(kind: str, parser: Callable[[str | None], list[dict]]) -> None:
    """Make a parser known for a kind of source; a kind has one parser."""
    if kind in ADAPTERS and ADAPTERS[kind] is not parser:
        raise ValueError(f"{kind} has a parser already")
    ADAPTERS[kind] = parser


_ATTRIBUTE = re.compile(r"""\sdata-[\w-]+\s*=\s*(?:"([^"]*[{\[][^"]*)"|'([^']*[{\[][^']*)')""")


def attribute_entries(raw: str | None) -> list[dict]:
    """Entries of the JSON that a page holds in data attributes, the first of each title."""
    out, seen = [], set()
    for a, b in _ATTRIBUTE.findall(raw or ""):
        for e in D.json_entries(html_entities.unescape(a or b)):
            if e["titel"] not in seen:
                seen.add(e["titel"])
                out.append(e)
    return out


register("newsroom_js", attribute_entries)


def dispatched(pages: DataFrame, kind: str, raw: str, source_url: str, exclude: str | None = None) -> DataFrame:
    """The pages' records (column e) by the parser of their kind, with the source's address; addresses that match ``exclude`` go."""
    parts = [pages.where(F.col(kind) == k).withColumn("e", F.explode(D._column(parser, RECORD, F.col(raw)))) for k, parser in sorted(ADAPTERS.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if exclude:
        out = out.where(~F.coalesce(F.col("e.url").rlike(exclude), F.lit(False)))
    return out.withColumn("quelle", F.col(source_url)).drop(raw)


# Second-level suffixes under which sites are registered.
SUFFIXES = ("co.uk", "com.br", "com.tr", "com.au", "co.jp", "com.mx", "co.za", "com.ar")


def parent_site(host: Column) -> Column:
    """The host without its first label, unless what remains is a suffix; hosts of two labels stay."""
    low = F.lower(host)
    parent = F.regexp_replace(low, r"^[^.]+\.", "")
    return F.when((F.size(F.split(low, r"\.")) <= 2) | parent.isin(*SUFFIXES), low).otherwise(parent)


def certificate_name(name: Column) -> Column:
    """A DNS name in lower case without wildcard and final dot; null if it is none."""
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^\*\.", ""), r"\.$", "")
    return F.when(n.rlike(r"^[a-z0-9_-]+(\.[a-z0-9_-]+)+$"), n)


def new_names(seen: DataFrame, known: DataFrame, technical: tuple[str, ...], most: int = 8) -> DataFrame:
    """domain, name, zuerst: names (domain, name, not_before) not known yet, without technical labels; a domain with more than ``most`` is a rollout and is left out."""
    label = F.substring_index("name", ".", 1)
    fresh = seen.where(F.col("name").isNotNull() & ~label.isin(*technical)).groupBy("domain", "name").agg(F.min("not_before").alias("zuerst")).join(known.select("name").distinct(), "name", "left_anti")
    few = fresh.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return fresh.join(few, "domain").select("domain", "name", "zuerst")


def json_ld(raw: str | None) -> list[dict]:
    """Every object of the JSON-LD of a page, at any depth."""
    out = []
    for block in D._LD.findall(raw or ""):
        try:
            todo = [json.loads(block)]
        except ValueError:
            continue
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += node
            elif isinstance(node, dict):
                out.append(node)
                todo += [v for v in node.values() if isinstance(v, (dict, list))]
    return out


DELIVERY = "struct<von:int,bis:int>"
_UNITS = {"DAY": 1, "DAYS": 1, "D": 1, "WEEK": 7, "WK": 7, "WEE": 7, "HUR": 1 / 24, "HOUR": 1 / 24}


def schema_delivery(raw: str | None) -> list[dict]:
    """Handling and transit time of the offers of a page, added up, in whole days; one record at most."""
    for node in json_ld(raw):
        times = [node[k] for k in ("handlingTime", "transitTime") if isinstance(node.get(k), dict)]
        if times:
            low = high = 0.0
            for t in times:
                unit = _UNITS.get(str(t.get("unitCode", "DAY")).upper(), 1)
                try:
                    first = float(t.get("minValue", t.get("value", 0)))
                    last = float(t.get("maxValue", t.get("value", first)))
                except (TypeError, ValueError):
                    break
                low, high = low + first * unit, high + last * unit
            else:
                return [{"von": int(low), "bis": int(-(-high // 1))}]
    return []


def observed_delivery(schema: Column, selector: Column, text: Column) -> Column:
    """struct<von, bis, methode, belastbarkeit, quarantaene>: structured data before a selected field before free text; more than 90 days, template braces or no hit are quarantined."""
    from quellwerk.functions.extract import bound, delivery_days

    def judged(x: Column) -> Column:
        a, b, c = x["a"], x["b"], x["c"]
        low, high = F.coalesce(a["von"], b["von"], c["von"]), F.coalesce(a["bis"], b["bis"], c["bis"])
        how = F.when(a.isNotNull(), "schema").when(b["bis"].isNotNull(), "feld").when(c["bis"].isNotNull(), "text")
        sure = F.when(how == "schema", "hoch").when(how == "feld", "mittel").when(how == "text", "niedrig")
        why = F.when(F.contains(F.coalesce(x["t"], F.lit("")), F.lit("{{")), "platzhalter").when(how.isNull(), "kein treffer").when(high > 90, "zu lang")
        return F.struct(low.alias("von"), high.alias("bis"), how.alias("methode"), sure.alias("belastbarkeit"), why.alias("quarantaene"))

    found = F.struct(F.try_element_at(schema, F.lit(1)).alias("a"), delivery_days(selector).alias("b"), delivery_days(text).alias("c"), text.alias("t"))
    return bound(found, judged)


class _Anchors(HTMLParser):
    """Links with the heading above them, and images with their widest source and the link around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.images, self.meta = [], [], {}
        self.heading, self.inside, self.href, self.text = "", None, None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a["content"])
        elif tag in ("h1", "h2", "h3"):
            self.inside, self.heading = tag, ""
        elif tag == "a":
            self.href, self.text = a.get("href"), []
        elif tag == "img":
            sources = [x.strip().split() for x in a.get("srcset", "").split(",") if x.strip()]
            wide = [(float(x[1][:-1]), x[0]) for x in sources if len(x) == 2 and re.fullmatch(r"\d+(\.\d+)?[wx]", x[1])]
            if wide or a.get("src"):
                self.images.append((max(wide)[1] if wide else a["src"], self.href))

    def handle_endtag(self, tag):
        if tag == self.inside:
            self.inside = None
        elif tag == "a" and self.href:
            self.links.append((self.href, " ".join(" ".join(self.text).split()), self.heading.strip()))
            self.href = None

    def handle_data(self, data):
        if self.inside:
            self.heading += data
        if self.href is not None:
            self.text.append(data)


PAGE = "struct<bild:string,links:array<struct<url:string,text:string,ueber:string>>,bilder:array<struct<url:string,link:string>>>"
MOST_LINKS, MOST_IMAGES = 30, 60


def page_candidates(raw: str | None, base: str | None) -> list[dict]:
    """The page's picture, its links to the same site with the heading above, its images with the link around; one record."""
    p = _Anchors()
    try:
        p.feed(raw or "")
    except (AssertionError, ValueError):
        return []
    absolute = lambda u: urljoin(base or "", u).split("#")[0] if u else None
    host = urlsplit(base or "").hostname
    links, seen = [], set()
    for href, text, above in p.links:
        url = absolute(href)
        if url and urlsplit(url).hostname == host and url not in seen:
            seen.add(url)
            links.append({"url": url, "text": text, "ueber": above or None})
    images = [{"url": absolute(u), "link": absolute(link)} for u, link in p.images]
    return [{"bild": absolute(p.meta.get("og:image") or p.meta.get("twitter:image")), "links": links[:MOST_LINKS], "bilder": images[:MOST_IMAGES]}]


def document_links(raw: str | None, base: str | None, pattern: str) -> list[dict]:
    """Absolute addresses of the page's links to its own host whose path matches, the first occurrence of each."""
    p = _Anchors()
    try:
        p.feed(raw or "")
    except (AssertionError, ValueError):
        return []
    host, out = urlsplit(base or "").hostname, {}
    for href, text, _ in p.links:
        url = urljoin(base or "", href).split("#")[0]
        if urlsplit(url).hostname == host and re.search(pattern, urlsplit(url).path):
            out.setdefault(url, text)
    return [{"url": u, "titel": t} for u, t in out.items()]


def content_hash(text: Column, links: Column) -> Column:
    """SHA-256 of a page's text and its sorted links without tracking: what must change for the page to have changed."""
    clean = F.array_sort(F.array_distinct(F.transform(F.coalesce(links, F.array().cast("array<string>")), U.normalize)))
    return F.sha2(F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.array_join(clean, "\n")), 256)


def full_text(feed: Column, article: Column, teaser: Column, least: int = 1200, most: int = 60000) -> Column:
    """struct<text, herkunft, grund>: the feed's text if it is long enough, else the article's if it has the length of one and says more than the teaser."""
    n, t = F.length(article), F.length(F.coalesce(teaser, F.lit("")))
    why = F.when(article.isNull(), "nicht geholt").when(n < least, "zu kurz").when(n > most, "zu lang").when(n < 1.5 * t, "nur anriss")
    from_feed = F.coalesce(F.length(feed) >= least, F.lit(False))
    text = F.when(from_feed, feed).when(why.isNull(), article)
    return F.struct(text.alias("text"), F.when(from_feed, "feed").when(why.isNull(), "artikel").alias("herkunft"), F.when(~from_feed, why).alias("grund"))


def staircase(table_text: Column) -> Column:
    """array<struct<kategorie, preis>>: prices of the line of amounts, each under the heading whose middle is nearest in columns.

    The first line is the heading, cells are parted by two blanks; amounts end with a euro sign.
    """
    lines = F.filter(F.split(table_text, "\n"), lambda x: F.trim(x) != "")
    head, row = F.try_element_at(lines, F.lit(1)), F.try_element_at(F.filter(lines, lambda x: x.rlike(r"\d+,\d\d\s*€")), F.lit(1))

    def cells(line: Column) -> Column:
        words = F.regexp_extract_all(line, F.lit(r"(\S+(?: \S+)*)"), 1)
        gaps = F.split(line, r"\S+(?: \S+)*")
        start = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(words, 1, i), F.lit(0), lambda s, x: s + F.length(x))
        return F.transform(words, lambda w, i: F.struct(w.alias("wort"), (start(i) + F.length(w) / 2).alias("mitte")))

    amounts = F.filter(cells(row), lambda c: c["wort"].rlike(r"^\d+(\.\d{3})*,\d\d\s*€$"))
    nearest = lambda c: F.array_min(F.transform(cells(head), lambda h: F.struct(F.abs(h["mitte"] - c["mitte"]).alias("d"), h["wort"].alias("wort"))))["wort"]
    price = lambda c: F.replace(F.replace(F.regexp_replace(c["wort"], r"\s*€", ""), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("double")
    return F.transform(amounts, lambda c: F.struct(nearest(c).alias("kategorie"), price(c).alias("preis")))


def is_tariff_document(text: Column) -> Column:
    """Does a text name itself a product information sheet or summary of a contract and a price?"""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike(r"produktinformationsblatt|vertragszusammenfassung") & low.rlike(r"grundgebühr|monatlicher preis|grundpreis")


def jsonl(lines: DataFrame, schema: str) -> DataFrame:
    """Records of the lines (column value) that hold an object of the schema; blank and broken lines are passed over."""
    r = F.from_json("value", f"{schema}, _kaputt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_kaputt"})
    return lines.where("trim(value) != ''").select(r.alias("r")).where("r is not null and r._kaputt is null").select("r.*").drop("_kaputt")


def synonyms(rows: DataFrame, canonical: str, words: str, order: str) -> DataFrame:
    """wort, name: every synonym with the first canonical name that claims it; a name is its own synonym."""
    claims = rows.select(F.col(order).alias("o"), F.col(canonical).alias("name"), F.explode(F.array_distinct(F.concat(F.array(canonical), F.coalesce(words, F.array().cast("array<string>"))))).alias("wort"))
    return claims.select("o", "name", F.lower(F.trim("wort")).alias("wort")).where("wort != ''").groupBy("wort").agg(F.min_by("name", F.struct("o", "name")).alias("name"))


def digest(rows: DataFrame, region: str, group: str, title: str, order: list[Column], most: int = 10) -> DataFrame:
    """region, betreiber, n, text: Markdown lines of the first few titles per region and operator, with the number of the rest."""
    from quellwerk.operators.relational import top_per_group

    total = rows.groupBy(region, group).agg(F.count("*").alias("n"))
    top = top_per_group(rows, [region, group], order, most, "_r")
    # at most ``most`` titles a group
    lines = top.groupBy(region, group).agg(F.array_sort(F.collect_list(F.struct("_r", F.concat(F.lit("- "), title).alias("t")))).alias("l"))
    j = lines.join(total, [region, group])
    more = F.when(F.col("n") > most, F.concat(F.lit("\n+ "), (F.col("n") - most).cast("string"), F.lit(" weitere"))).otherwise(F.lit(""))
    return j.select(region, group, "n", F.concat(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), more).alias("text"))
