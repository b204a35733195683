"""Parsers of fetched documents: pandas over Arrow batches, one record per row.

All take a column of raw text and give arrays of structs, so callers explode
and project as they like.  Broken documents give empty arrays, never errors.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F

ENTRY = "struct<titel:string,url:string,datum:string,text:string,bild:string>"
LINK = "struct<url:string,titel:string>"
PRODUCT = "struct<name:string,sku:string,preis:string,waehrung:string,verfuegbar:string>"
MEDIA = "struct<url:string,bild:string,volltext:string>"
RULE = "struct<erlaubt:boolean,pfad:string>"
MOST_ENTRIES, MOST_TEXT, MOST_RECORDS, MOST_DEPTH = 60, 600, 400, 8

_TAG = re.compile(r"<[^>]+>")


def plain(html: str | None) -> str:
    """Text of a fragment, white space collapsed."""
    text = _TAG.sub(" ", html or "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = text.replace(a, b)
    return " ".join(text.split())


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


_STRAY = re.compile(r"&(?!(?:[a-zA-Z]+|#\d+|#x[0-9a-fA-F]+);)")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_ENTRY = re.compile(r"<(item|entry)\b[^>]*>.*?(?=<(?:item|entry)\b|</(?:item|entry)>|\Z)", re.S | re.I)
_CHILD = re.compile(r"<(title|link|pubDate|published|updated|date|description|summary|content|encoded)\b([^>]*?)(?:/>|>(.*?)</\1\s*>)", re.S | re.I)
_CDATA = re.compile(r"<!\[CDATA\[|\]\]>")
FULL_TEXT = 1200


def _tree(raw: str):
    """The document, as it is or with stray ampersands and control characters mended; None if neither parses."""
    for text in (raw, _CONTROL.sub("", _STRAY.sub("&amp;", raw))):
        try:
            return ET.fromstring(text)
        except (ET.ParseError, ValueError):
            pass
    return None


def _nodes(raw: str):
    """(name, text, attributes) of the children of every entry; a document that cannot be mended is read entry by entry."""
    root = _tree(raw)
    if root is not None:
        for node in root.iter():
            if _local(node.tag) in ("item", "entry"):
                yield [(_local(c.tag), c.text or "", c.attrib) for c in node]
        return
    for m in _ENTRY.finditer(raw):
        part = _tree(f"<r>{m.group()}</{m.group(1)}></r>")
        if part is not None and len(part):
            yield [(_local(c.tag), c.text or "", c.attrib) for c in part[0]]
        else:
            yield [(n.lower(), _CDATA.sub("", t) if "<![CDATA[" in t else unescape(t), dict(re.findall(r"(\w+)\s*=\s*[\"']([^\"']*)", a))) for n, a, t in _CHILD.findall(m.group())]


def feed_entries(raw: str | None) -> list[dict]:
    """Entries of an RSS or Atom document with title and link, at most sixty; malformed documents are mended."""
    out = []
    for children in _nodes((raw or "").strip()):
        held: dict[str, str] = {}
        for name, text, attributes in children:
            if name == "link":
                held.setdefault("url", (attributes.get("href") or text).strip())
            elif name == "title":
                held.setdefault("titel", plain(text))
            elif name in ("pubdate", "published", "updated", "date"):
                held.setdefault("datum", text.strip())
            elif name in ("enclosure", "thumbnail", "content") and attributes.get("url"):
                held.setdefault("bild", attributes.get("url"))
            elif name in ("description", "summary", "content", "encoded"):
                held["text"] = max(held.get("text", ""), plain(text), key=len)
        if held.get("titel") and held.get("url"):
            out.append({"titel": held["titel"], "url": held["url"], "datum": held.get("datum"), "text": held.get("text", "")[:MOST_TEXT], "bild": held.get("bild")})
        if len(out) == MOST_ENTRIES:
            break
    return out


_IMAGE = re.compile(r"<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']+)", re.I)


def feed_media(raw: str | None) -> list[dict]:
    """Per entry its address, its first media address or first image of its text, and its longest text if it is a full one."""
    out = []
    for children in _nodes((raw or "").strip()):
        url, media, images, longest = None, None, None, ""
        for name, text, attributes in children:
            if name == "link":
                url = url or (attributes.get("href") or text).strip()
            if name in ("enclosure", "thumbnail", "content") and attributes.get("url") and not attributes.get("type", "image").startswith(("audio", "video")):
                media = media or attributes["url"]
            if name in ("description", "summary", "content", "encoded"):
                found = _IMAGE.search(text)
                images = images or (found.group(1) if found else None)
                longest = max(longest, plain(text), key=len)
        if url:
            out.append({"url": url, "bild": media or images, "volltext": longest if len(longest) >= FULL_TEXT else None})
    return out


# Names under which records carry a field.
_FIELDS = {"titel": ("title", "headline", "name", "titel"), "url": ("url", "link", "href", "permalink"), "datum": ("date", "published", "publishedat", "pubdate", "datum"), "text": ("summary", "description", "teaser", "excerpt"), "bild": ("image", "thumbnail", "bild")}


def _pick(record: dict, names: tuple[str, ...]) -> str | None:
    low = {str(k).lower(): v for k, v in record.items()}
    for n in names:
        v = low.get(n)
        if isinstance(v, dict):
            v = v.get("rendered") or v.get("url")
        if isinstance(v, (str, int, float)) and str(v).strip():
            return plain(str(v))
    return None


def _record_lists(node, depth: int = 0) -> list[dict]:
    """Records of every list of objects at least half of which have a title, down to a depth."""
    if depth > MOST_DEPTH:
        return []
    if isinstance(node, list):
        objects = [x for x in node if isinstance(x, dict)]
        if objects and 2 * sum(_pick(x, _FIELDS["titel"]) is not None for x in objects) >= len(objects):
            return objects
        return [r for x in node for r in _record_lists(x, depth + 1)]
    if isinstance(node, dict):
        return [r for x in node.values() for r in _record_lists(x, depth + 1)]
    return []


def json_entries(raw: str | None) -> list[dict]:
    """Entries of any JSON document, found by shape: the newest four hundred, the first of each title."""
    try:
        node = json.loads(raw or "")
    except ValueError:
        return []
    out, seen = [], set()
    entries = [{k: _pick(r, names) for k, names in _FIELDS.items()} for r in _record_lists(node)]
    # newest first, as far as dates sort as text; records without one keep their order behind them
    entries.sort(key=lambda e: e["datum"] or "", reverse=True)
    for e in entries[:MOST_RECORDS]:
        if e["titel"] and e["titel"] not in seen:
            seen.add(e["titel"])
            out.append(e)
    return out


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.href, self.text, self.skip = [], None, [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("nav", "footer", "script", "style"):
            self.skip += 1
        elif tag == "a" and not self.skip:
            self.href, self.text = a.get("href"), [a.get("aria-label") or ""]

    def handle_endtag(self, tag):
        if tag in ("nav", "footer", "script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.href:
            title = " ".join(" ".join(self.text[1:]).split()) or (self.text[0] or "")
            self.found.append((self.href, title))
            self.href = None

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)


def page_links(raw: str | None, base: str | None, least: int = 25, most: int = 300) -> list[dict]:
    """Links of a page outside menus and footers: absolute, same site, the first of each address, titles of a headline's length."""
    parser = _Links()
    try:
        parser.feed(raw or "")
    except (AssertionError, ValueError):
        return []
    site = ".".join((urlsplit(base or "").hostname or "").split(".")[-2:])
    out, seen = [], set()
    for href, title in parser.found:
        try:
            url = urljoin(base or "", href).split("#")[0]
            own = ".".join((urlsplit(url).hostname or "").split(".")[-2:])
        except ValueError:
            continue
        if url.startswith("http") and own == site and url not in seen and least <= len(title) <= most:
            seen.add(url)
            out.append({"url": url, "titel": title})
    return out


_LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.S | re.I)


def page_products(raw: str | None) -> list[dict]:
    """schema.org products in the JSON-LD of a page, at any depth, once per name and price."""
    out, seen = [], set()
    for block in _LD.findall(raw or ""):
        try:
            todo = [json.loads(block)]
        except ValueError:
            continue
        while todo:
            node = todo.pop(0)
            if isinstance(node, list):
                todo = node + todo
            elif isinstance(node, dict):
                todo = [v for v in node.values() if isinstance(v, (dict, list))] + todo
                kinds = node.get("@type")
                if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
                    offers = node.get("offers") or {}
                    offer = offers[0] if isinstance(offers, list) and offers else offers if isinstance(offers, dict) else {}
                    price = offer.get("price", offer.get("lowPrice"))
                    key = (node.get("name"), str(price))
                    if node.get("name") and key not in seen:
                        seen.add(key)
                        out.append({"name": str(node["name"]), "sku": str(node["sku"]) if node.get("sku") else None, "preis": None if price is None else str(price), "waehrung": offer.get("priceCurrency"), "verfuegbar": str(offer.get("availability") or "").rpartition("/")[2] or None})
    return out


def robots_rules(raw: str | None, agent: str = "*") -> list[dict]:
    """Allow and Disallow rules of the groups for an agent."""
    out, mine, heads = [], False, True
    for line in (raw or "").splitlines():
        name, _, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            mine = (mine if heads else False) or value.lower() == agent.lower()
            heads = True
        elif name in ("allow", "disallow"):
            heads = False
            if mine and value:
                out.append({"erlaubt": name == "allow", "pfad": value})
    return out


def robots_allows(rules: list[dict], path: str) -> bool:
    """Longest matching rule decides, Allow wins ties, no match allows; * and $ are patterns."""
    best = (-1, True)
    for r in rules:
        pattern = re.escape(r["pfad"]).replace(r"\*", ".*")
        if re.match(pattern[:-2] + "$" if pattern.endswith(r"\$") else pattern, path):
            best = max(best, (len(r["pfad"]), r["erlaubt"]))
    return best[1]


def _column(function, kind: str, *columns):
    """A pandas UDF of a parser, made when a session is there."""
    return F.pandas_udf(lambda *raw: pd.Series([function(*x) for x in zip(*raw)], dtype=object), f"array<{kind}>", F.PandasUDFType.SCALAR)(*columns)


def parse_feed(raw):
    return _column(feed_entries, ENTRY, raw)


def parse_media(raw):
    return _column(feed_media, MEDIA, raw)


def parse_json(raw):
    return _column(json_entries, ENTRY, raw)


def parse_products(raw):
    return _column(page_products, PRODUCT, raw)


def parse_robots(raw):
    return _column(robots_rules, RULE, raw)


def allowed(raw, path):
    """Whether robots rules allow a path to everyone."""
    return F.pandas_udf(lambda r, p: pd.Series([robots_allows(robots_rules(x), y) for x, y in zip(r, p)], dtype=bool), "boolean", F.PandasUDFType.SCALAR)(raw, path)


def parse_links(raw, base):
    return _column(page_links, LINK, raw, base)
