"""Template residue, filler and error pages (problem 4).

Filler, error messages and script notices are whole paragraphs with fixed
wording (residue_rules).  A template variable inside prose is settled by
alignment: records of one template are brought together by their skeleton,
the sentence without names, numbers and variables, whose gaps are the slots.
A variable in a slot that sibling records fill with values is residue; a
variable that the template itself quotes stands in all its records and is
article text.  Skeletons are counted by a hash aggregation with map-side
combine, so a template with a third of all rows is no hot spot.

Whole-page templates are induced from all pages, whatever their wording: a body
(the page without its furniture, figures aside) that stands under nearly as many
titles as rows, and in several sources, is what sites show in place of articles;
copies of an article keep its title.

Defined results: null or empty paragraph lists are no case; a paragraph of
variables alone is residue; the row is given once however many paragraphs
match.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.llm.pages import article_positions
from quellwerk.llm.residue_rules import RESIDUE, VARIABLE, VARIABLES, kind, variables
from quellwerk.session import materialise

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*(?=[A-ZÀ-ÞА-ЯĄ-Ž“„«»「{$#<%@\[_぀-鿿])|\n")
_GAPS = re.compile(r"(?:\x00|\d+(?:[.,:  ]\d+)*|\b[A-ZÀ-ÞĄ-Ž][\w’']*(?:\s+(?:\d+|[A-ZÀ-ÞĄ-Ž]\w*|5G))*)(?:\s*\x00)*")
_RUNS = re.compile(r"\x00(?:\s*\x00)+")


def skeleton(sentence: str) -> str:
    """The sentence with one gap for every name, number or variable."""
    s = VARIABLES.sub("\x00", sentence)
    return _RUNS.sub("\x00", _GAPS.sub("\x00", " ".join(s.split())))


def _has_words(text: str) -> bool:
    return any(len(w) > 1 for w in re.findall(r"[^\W\d_]+", VARIABLES.sub(" ", text)))


#: Titles and sources a whole-page template stands under at least, and titles against rows.
TITLES, SOURCES, APART = 3, 3, 0.9
_FIGURES = re.compile(r"\d\S*")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def body_hash(page) -> int | None:
    """Hash of the article paragraphs of a page, case, white space and figures aside; None if it has none."""
    own = article_positions(page)
    return _hash(_FIGURES.sub("0", " ".join("\n".join(page[i] for i in own).lower().split()))) if own else None


def page_templates(bodies: DataFrame) -> DataFrame:
    """body of every whole-page template, from rows (body, head, source)."""
    per_title = bodies.groupBy("body", "head").agg(F.count("*").alias("n"))
    per_source = bodies.groupBy("body", "source").agg(F.count("*").alias("m")).groupBy("body").agg(F.count("*").alias("sources"))
    many = per_title.groupBy("body").agg(F.count("*").alias("titles"), F.sum("n").alias("rows")).where((F.col("titles") >= TITLES) & (F.col("titles") >= APART * F.col("rows")))
    return many.join(per_source, "body").where(F.col("sources") >= SOURCES).select("body")


def residue(pages: DataFrame, key: str = "zeilen_nr", blocks: str = "absaetze", title: str = "titel_original", origin: str = "quelle") -> DataFrame:
    """key of every page with at least one residue paragraph; without title and origin columns no whole-page templates are induced."""
    whole = title in pages.columns and origin in pages.columns

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per page: decided residue (sure = 1), else every open variable with its skeleton."""
        for batch in batches:
            out = []
            for k, page, head, place in zip(batch["k"].tolist(), batch["b"].tolist(), batch["t"].tolist(), batch["q"].tolist()):
                if page is None:
                    continue
                for p in page:
                    what = kind(p)
                    if what == RESIDUE:
                        out.append((k, 1, None, None, 0, None, None, None))
                        break
                    if what == VARIABLE:
                        if not _has_words(p):
                            out.append((k, 1, None, None, 0, None, None, None))
                            break
                        for s in _SENTENCE.split(p):
                            if s:
                                out += [(k, 0, skeleton(s), name, int(quoted), None, None, None) for name, quoted in variables(s)]
                else:
                    body = body_hash(page) if whole else None
                    if body is not None:
                        out.append((k, 2, None, None, 0, body, _hash((head or "").lower()[:16]), _hash(place or "")))
            frame = pd.DataFrame(out, columns=["k", "sure", "skeleton", "variable", "quoted", "body", "head", "source"])
            yield frame.astype({"body": "Int64", "head": "Int64", "source": "Int64"})

    extra = [f"`{title}` as t", f"`{origin}` as q"] if whole else ["cast(null as string) as t", "cast(null as string) as q"]
    read = pages.where(f"`{key}` is not null").selectExpr(f"cast(`{key}` as bigint) as k", f"`{blocks}` as b", *extra)
    source = read.select("k", "b")
    judged = materialise(read.mapInPandas(judge, "k bigint, sure int, skeleton string, variable string, quoted int, body bigint, head bigint, source bigint"), "residue")
    open_ = judged.where("sure = 0")
    templates = open_.groupBy("skeleton").agg(F.countDistinct("k").alias("with_variable"), F.countDistinct("variable").alias("names"), F.max("quoted").alias("some_quoted"))
    # siblings decide only where the template itself may hold the variable
    doubtful = materialise(templates.where("some_quoted = 1 or with_variable >= 3 and names = 1"), "templates")
    filled = _filled(source, doubtful).withColumnRenamed("skeleton", "s")
    known = open_.join(doubtful, "skeleton", "left").join(filled, F.col("skeleton") == F.col("s"), "left")
    siblings = F.coalesce("filled", F.lit(0))
    # a constant of the template: quoted, or the same variable in every one of at least three records
    constant = (F.col("quoted") == 1) & (siblings <= F.col("with_variable")) | (siblings == 0) & (F.col("with_variable") >= 3) & (F.col("names") == 1)
    flagged = known.where(~F.coalesce(constant, F.lit(False))).select("k")
    bodies = judged.where("sure = 2").select("k", "body", "head", "source")
    shown = bodies.join(page_templates(bodies), "body", "left_semi").select("k")
    return judged.where("sure = 1").select("k").union(flagged).union(shown).distinct().select(F.col("k").alias(key))


#: Templates whose anchor words are sent to the tasks; with more of them every sentence is aligned.
MOST_ANCHORS = 5000
_LOWER = re.compile(r"[^\W\d_]{4,}")


def anchor(form: str) -> str | None:
    """The longest word of a skeleton, by which sentences of its template are found."""
    words = _LOWER.findall(form)
    return max(words, key=lambda w: (len(w), w)) if words else None


def _filled(source: DataFrame, templates: DataFrame) -> DataFrame:
    """skeleton, filled: how often the sentences of the templates occur with their slots filled, over all pages."""
    forms = [r[0] for r in templates.select("skeleton").limit(MOST_ANCHORS + 1).collect()]
    anchors = {anchor(x) for x in forms}
    every = len(forms) > MOST_ANCHORS or None in anchors
    wanted = frozenset(forms) if len(forms) <= MOST_ANCHORS else None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for page in batch["b"].tolist():
                for p in page if page is not None else ():
                    if not p or any(c in p for c in "{$<%@") or not every and anchors.isdisjoint(_LOWER.findall(p)):
                        continue
                    for s in _SENTENCE.split(p):
                        if s and (every or not anchors.isdisjoint(_LOWER.findall(s))):
                            form = skeleton(s)
                            if wanted is None or form in wanted:
                                seen[form] += 1
            if seen:
                yield pd.DataFrame({"skeleton": list(seen), "n": pd.Series(list(seen.values()), dtype="int64")})

    if not forms:
        source = source.limit(0)  # no template is in doubt
    return source.mapInPandas(count, "skeleton string, n bigint").groupBy("skeleton").agg(F.sum("n").alias("filled"))
