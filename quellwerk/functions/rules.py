"""Rules on titles, claims, numbers, tokens and addresses: Column -> Column, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.functions import urls as U

# Titles that are labels of a page, and openings of such titles.
LABELS = ("home", "news", "contact", "mehr", "more", "weiterlesen", "read more", "press", "archive")
OPENINGS = ("share", "follow us", "subscribe", "sign up", "press release archive")
# Words that carry no meaning in a title.
STOP = ("der", "die", "das", "und", "in", "im", "von", "the", "and", "of", "a", "for", "el", "la", "de", "y", "en", "le", "les", "et", "il", "di", "e", "w", "na", "i", "z")


def without_date_label(title: Column) -> Column:
    """The title without a day and a label before it, such as "Press release 28 May 2026"."""
    return F.trim(F.regexp_replace(title, r"(?i)^(?:press release|news|pressemitteilung)?\s*\d{1,2}(?:st|nd|rd|th|\.)?\s+\p{L}+\s+\d{4}\s*[-–:|]?\s*", ""))


def junk_title(title: Column) -> Column:
    """Is a title a label, a short one with a label's opening, or one word repeated?"""
    t = F.lower(F.trim(title))
    words = F.array_distinct(F.split(t, r"\s+"))
    opening = F.exists(F.array(*map(F.lit, OPENINGS)), lambda o: t.startswith(o)) & (F.length(t) < 45)
    return t.isin(*LABELS) | opening | ((F.size(F.split(t, r"\s+")) > 1) & (F.size(words) == 1)) | (t == "")


def sentence_fault(text: Column, consequence: tuple[str, ...], boilerplate: tuple[str, ...], least: int = 4, most: int = 28) -> Column:
    """Why a sentence is refused: laenge, punkte (more than two), floskel, ohne_folge; null if it is fine."""
    low = T.low(F.trim(F.coalesce(text, F.lit(""))))
    n = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    any_of = lambda words, test: F.exists(F.array(*map(F.lit, words)), test)
    dots = F.length(low) - F.length(F.replace(low, F.lit("."), F.lit("")))
    return F.when(~n.between(least, most), "laenge").when(dots > 2, "punkte").when(any_of(boilerplate, lambda w: low.startswith(w)), "floskel").when(~any_of(consequence, lambda w: F.contains(low, w)), "ohne_folge")


def plain_numbers(text: Column) -> Column:
    """array<double>: the numbers of a text, decimal comma or point; nothing for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:[.,]\d+)?)"), 1)
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))


def uncovered(claim: Column, source: Column, slack: float = 1.0) -> Column:
    """Sorted numbers of a claim that no number of the source comes near; single digits need no proof."""
    held = plain_numbers(source)
    return F.array_sort(F.array_distinct(F.filter(plain_numbers(claim), lambda x: (x >= 10) & ~F.exists(held, lambda y: F.abs(x - y) <= slack))))


def salient(text: Column) -> Column:
    """Sorted numbers with their unit in one spelling; without a unit only decimals and numbers of four digits and more, years left out."""
    found = F.regexp_extract_all(T.low(F.coalesce(text, F.lit(""))), F.lit(r"(\d+(?:[.,]\d+)?\s*(?:gbit/s|mbit/s|ghz|mhz|gb|tb|€|euro|eur|%|prozent|percent|procent|millisekunden|ms)?)"), 1)
    unit = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"\d\s*([^\d\s.,].*)?$", 1), r"^(?:euro|eur)$", "€"), r"^(?:prozent|percent|procent)$", "%"), r"^millisekunden$", "ms")
    number = lambda x: F.replace(F.regexp_extract(x, r"^(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit("."))
    both = F.transform(found, lambda x: F.struct(number(x).alias("n"), unit(x).alias("u")))
    kept = F.filter(both, lambda p: (p["u"] != "") | (F.contains(p["n"], F.lit(".")) | p["n"].rlike(r"^\d{4,}$")) & ~p["n"].rlike(r"^(19\d\d|20\d\d|2100)$"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda p: F.concat(p["n"], p["u"]))))


def tokenizers(text: Column) -> dict[str, Column]:
    """Six ways to cut a text: lang (four letters, hyphens inside), stamm (three, no stop words, stemmed), beutel (two, no stop words, with repeats), drei, wort (four word characters), vier."""
    low = T.low(F.coalesce(text, F.lit("")))
    cut = lambda pattern: F.filter(F.split(low, pattern), lambda w: w != "")
    plain = cut(r"[^a-z0-9äöüß]+")
    no_stop = lambda words, n: F.filter(words, lambda w: (F.length(w) >= n) & ~w.isin(*STOP))
    return {
        "lang": F.array_distinct(F.filter(F.transform(cut(r"[^a-z0-9äöüß-]+"), lambda w: F.regexp_replace(w, r"^-+|-+$", "")), lambda w: F.length(w) >= 4)),
        "stamm": F.array_distinct(F.transform(no_stop(plain, 3), T.stem)),
        "beutel": no_stop(plain, 2),
        "drei": F.array_distinct(no_stop(plain, 3)),
        "wort": F.array_distinct(F.filter(cut(r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 4)),
        "vier": F.array_distinct(no_stop(plain, 4)),
    }


def cut_text(text: Column, sentences: int, most: int) -> Column:
    """The first sentences of a text that fit into so many characters; if the first does not, it is cut at a word's end with an ellipsis."""
    from quellwerk.functions.checks import sentences as split

    parts = F.slice(split(text), 1, sentences)
    fit = F.aggregate(parts, F.lit(""), lambda s, x: F.when((F.length(s) + F.length(x) + 1 <= most) & ((s != "") | (F.length(x) <= most)), F.trim(F.concat(s, F.lit(" "), x))).otherwise(s))
    return F.when(text.isNull(), None).when((fit != "") | (F.size(parts) == 0), fit).otherwise(T.truncated(F.element_at(parts, 1), most))


def schemeless(url: Column) -> Column:
    """Address in lower case without scheme, www. and final slash, query and all."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://", ""), r"^www\.", ""), r"/+$", "")


def site(url: Column, suffixes: tuple[str, ...]) -> Column:
    """Registrable domain: the last two labels, or three where the last two are a public suffix."""
    host = U.host(url)
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def argmax_theme(text: Column, themes: dict[str, tuple[str, ...]], blocked: Column, exclude: str) -> Column:
    """The theme with most anchors in a text, the first in order among equals; anchors in blanks count as whole words. Null if none is met, the row is blocked or the text matches ``exclude``."""
    low = F.concat(F.lit(" "), F.regexp_replace(T.low(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    hits = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in themes.items()}
    best = F.greatest(*hits.values(), F.lit(0))
    out = F.when((best == 0) | F.coalesce(blocked, F.lit(False)) | low.rlike(exclude), None)
    for k, n in hits.items():
        out = out.when(n == best, F.lit(k))
    return out
