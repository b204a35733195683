"""Rows with the same article (problem 5): bottom-k sketches and inverted lists.

1.  A row's article is its own paragraphs; its elements are the word shingles.
    One hash function maps shingles to 64 bits; the k smallest are the sketch.
2.  Exact copies are one class, represented by their smallest row number.
3.  Inverted lists: the values of every sketch that another text may have are put
    in one order over all texts, rare ones first, and the leading ones are chosen:
    of n values with m in common, both texts choose at least m - (n - chosen) of
    those.  The values are hashes, so in their own order the chosen common ones lie
    among the others by chance; every two that are no farther apart than a few
    places are posted as one key.  Near copies have many neighbours in common, and
    texts with a phrase or two in common hardly any, so the lists do not grow with
    the square of all texts that use the same phrases.  No list is cut, divided or
    gathered; a long one is an equi-join that is split when hot.
4.  Pairs met often enough are estimated with their union sketch, and those above
    the filter get the exact Jaccard of their shingle sets.
5.  The definition of the same article is then checked sentence by sentence.

Defined results: rows without article text form no pairs; identical texts are
pairs whatever their length; a text shorter than one shingle is one element;
repeated row numbers count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.llm.pages import article_positions
from quellwerk.llm.sentence_rules import sentence_spans
from quellwerk.session import drop, materialise

#: Words per shingle, values kept per sketch, share of them that is chosen for posting, cells of the table that orders values, texts handled at once.
SHINGLE, SKETCH, POSTED, CELLS, STEP = 5, 64, 0.65, 1 << 21, 256
#: Share of the values that another text may have that is chosen at least, within the number above.
SHARED = 0.8
#: Keys of a text, about, and places that two values of a key may be apart at least.
KEYS, REACH = 168, 4
#: Pairs must meet in so many lists and have so many values in common (one, if a text has few values), reach this estimated and this exact Jaccard.
LISTS, MEETINGS, SHORT, ESTIMATE, JACCARD = 2, 3, 4, 0.12, 0.2
#: Share of the longer row's sentences that must stand in the other; share of a sentence's words that may differ.
SHARE, CHANGED = 0.8, 0.34
#: Turns in which the meetings are shuffled.
TURNS = 2

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Script of a character: words end where it changes (0: no word character).
_POINTS = 0x30000
_script = np.zeros(0, np.uint8)
_weight = np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(longest: int) -> None:
    """Scripts of all characters and powers up to the longest word, once per process."""
    global _script, _weight
    if not len(_script):
        _script = np.fromiter((chr(c).isalnum() or c == 95 for c in range(_POINTS)), np.uint8, _POINTS)
        for code, (low, high) in enumerate(((0x4E00, 0x9FFF), (0x3040, 0x309F), (0x30A0, 0x30FF)), 2):
            _script[low : high + 1] = code
    if len(_weight) < longest:
        _weight = np.cumprod(np.full(max(64, 2 * longest), 0x5851F42D4C957F2D, np.uint64))


def lower(text: str) -> str:
    """Lower case of the same length: the dotted capital is the one letter that would become two."""
    return text.replace("\u0130", "i").lower()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every word, where it starts in its text, and the offsets of each text's words."""
    joined = "\n".join([lower(t) for t in texts] + [""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    _tables(0)
    kind = _script[np.minimum(points, _POINTS - 1)]
    kind[points >= _POINTS] = 0
    first = kind > 0
    first[1:] &= kind[1:] != kind[:-1]
    held = np.flatnonzero(kind)
    at = np.flatnonzero(first[held])
    starts = held[at]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(texts) + 1, np.int64)
    lengths = np.diff(np.append(at, len(held)))
    _tables(int(lengths.max()))
    inside = np.arange(len(held)) - np.repeat(at, lengths)
    hashes = _mix(np.add.reduceat(points[held].astype(np.uint64) * _weight[inside], at))
    offsets = np.searchsorted(starts, np.append(begins, len(points)))
    return hashes, starts - np.repeat(begins, np.diff(offsets)), offsets


def shingle_hashes(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, and the offsets of each text."""
    words, _, offsets = word_hashes(texts)
    sizes = np.diff(offsets)
    room = np.repeat(offsets[1:], sizes) - np.arange(len(words))  # words left in the text, this one counted
    acc = np.zeros(len(words), np.uint64)
    whole = int(sizes.min()) >= n if len(sizes) else False
    for j in range(n):
        shifted = np.zeros_like(words)
        if j < len(words):
            shifted[: len(words) - j] = words[j:]
        mixed = (acc * _GOLD + shifted) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        acc = mixed if whole else np.where(room > j, mixed, acc)
    acc = _mix(acc)
    parts, ends = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = np.unique(acc[a : b - n + 1] if b - a >= n else acc[a : min(a + 1, b)])
        parts.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(parts) if parts else acc, np.array(ends)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """Jaccard estimated from the k smallest values of the union of two sketches."""
    union = np.union1d(a, b)[: max(1, min(k, len(a) + len(b)))]
    return float(np.isin(union, np.intersect1d(a, b)).mean())


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def exact_jaccard(a: str, b: str, n: int = SHINGLE) -> float:
    h, o = shingle_hashes([a, b], n)
    return _jaccard(h[o[0] : o[1]], h[o[1] : o[2]])


def _distance(a: tuple, b: tuple, most: int) -> int:
    """Edits between two word lists, or most + 1."""
    common = set(a) & set(b)
    # the longer list less the words that may pair with an equal one
    if abs(len(a) - len(b)) > most or max(len(a), len(b)) - min(sum(x in common for x in a), sum(x in common for x in b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def sentence_lists(texts: list[str]) -> list[tuple[tuple[int, ...], ...]]:
    """Hashes of the words of every sentence of every text."""
    words, starts, offsets = word_hashes(texts)
    out = []
    for i, t in enumerate(texts):
        spans = sentence_spans(t)
        own = words[offsets[i] : offsets[i + 1]].tolist()
        cuts = np.searchsorted(starts[offsets[i] : offsets[i + 1]], [a for a, _ in spans]).tolist() + [len(own)]
        out.append(tuple(tuple(own[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b))
    return out


def sentence_words(text: str) -> tuple[tuple[int, ...], ...]:
    """Hashes of the words of every sentence."""
    return sentence_lists([text])[0]


class Recent(dict):
    """Sentences of the texts compared last, kept per process up to a fixed number."""

    def add(self, texts: set[str]) -> None:
        if len(self) > 20_000:
            self.clear()
        new = sorted(texts - self.keys())
        self.update(zip(new, sentence_lists(new)))

    def __missing__(self, text: str):
        self.add({text})
        return self[text]


_sentences = Recent()


def shared_sentences(a: str, b: str, changed: float = CHANGED) -> float:
    """Share of the longer text's sentences that stand in the other, each used once, a few words changed at most."""
    x, y = _sentences[a], _sentences[b]
    if len(x) < len(y):
        x, y = y, x
    if not y:
        return 0.0
    where: dict[tuple, list[int]] = {}
    for j, s in enumerate(y):
        where.setdefault(tuple(s), []).append(j)
    done_x, done_y = set(), set()
    for i, s in enumerate(x):
        if where.get(tuple(s)):
            done_x.add(i)
            done_y.add(where[tuple(s)].pop())
    near = []
    for i, s in enumerate(x):
        for j, t in enumerate(y) if i not in done_x else ():
            if j not in done_y and (d := _apart(s, t, changed)) <= 1.0:
                near.append((d, i, j))
    for _, i, j in sorted(near):
        if i not in done_x and j not in done_y:
            done_x.add(i)
            done_y.add(j)
    # a changed mark may have joined or parted two sentences
    for j in range(len(y)):
        for i in range(len(x) - 1) if j not in done_y else ():
            if i not in done_x and i + 1 not in done_x and _apart(x[i] + x[i + 1], y[j], changed) <= 1.0:
                done_x |= {i, i + 1}
                done_y.add(j)
                break
    for i in range(len(x)):
        for j in range(len(y) - 1) if i not in done_x else ():
            if j not in done_y and j + 1 not in done_y and _apart(x[i], y[j] + y[j + 1], changed) <= 1.0:
                done_x.add(i)
                done_y |= {j, j + 1}
                break
    return len(done_x) / len(x)


def _apart(s: tuple, t: tuple, changed: float) -> float:
    """Edited words against the number that may be edited; above 1 if there are more."""
    most = max(1, int(changed * max(len(s), len(t))))
    d = _distance(s, t, most)
    return d / most if d <= most else 2.0


def articles(pages: DataFrame, key: str, blocks: str, title: str | None = None) -> DataFrame:
    """key, text (article paragraphs, one per block), digest (of the text without its white space), sketch (of title and text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts, whole = [], [], []
            for k, page, head in zip(batch["k"].tolist(), batch["b"].tolist(), batch["t"].tolist()):
                own = article_positions(page)
                if own:
                    keys.append(k)
                    texts.append("\n\n".join(page[i] for i in own))
                    whole.append(f"{head}\n\n{texts[-1]}" if head else texts[-1])
            for i in range(0, len(texts), STEP):
                hashes, offsets = shingle_hashes(whole[i : i + STEP])
                signed = hashes.view(np.int64)
                digests = [hashlib.blake2b(" ".join(t.split()).encode("utf-8", "replace"), digest_size=16).digest() for t in texts[i : i + STEP]]
                sketches = [signed[a : min(a + SKETCH, b)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pd.DataFrame({"k": pd.Series(keys[i : i + STEP], dtype="int64"), "text": texts[i : i + STEP], "digest": digests, "sketch": sketches})

    head = f"`{title}`" if title in pages.columns else "cast(null as string)"
    source = pages.where(f"`{key}` is not null").selectExpr(f"cast(`{key}` as bigint) as k", f"`{blocks}` as b", f"{head} as t")
    return source.mapInPandas(run, "k bigint, text string, digest binary, sketch array<bigint>")


def value_order(classes: DataFrame) -> np.ndarray:
    """Level (logarithm of its postings, 0: one at most) of every cell of a table of fixed size, to which the retained values are hashed.

    Any fixed order of the values keeps the candidate search exact; this one puts values of many texts last.
    """
    cell = F.explode("sketch").alias("v")
    counts = classes.select(cell).groupBy(F.col("v").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("c")).agg(F.count("*").alias("n")).where("n > 1")
    rows = counts.select("c", F.least(F.lit(255), F.round(F.log2("n") * 8)).cast("short").alias("l")).toArrow()  # at most CELLS rows, as columns
    out = np.zeros(CELLS, np.uint8)
    out[rows["c"].to_numpy()] = rows["l"].to_numpy()
    return out


def _levels(classes: DataFrame) -> Broadcast:
    return classes.sparkSession.sparkContext.broadcast(value_order(classes))


def posted(size: int | np.ndarray) -> int | np.ndarray:
    """How many of a sketch's values are chosen for inverted lists: all of a small one, else this share."""
    return np.minimum(size, np.maximum(2 * SHORT, np.ceil(POSTED * size).astype(np.int64)))


def postings(classes: DataFrame, level: Broadcast, turn: int = 0, turns: int = 1) -> DataFrame:
    """k, l: every two chosen values of a sketch that are near each other in the order of the hashes, each a list that others may meet, or the lists whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, sketch = batch.column(0).to_numpy(), batch.column(1)
            sizes = sketch.value_lengths().to_numpy().astype(np.int64)
            values = sketch.flatten().to_numpy()
            of = level.value[values & (CELLS - 1)]
            owner = np.repeat(np.arange(len(k)), sizes)
            # a value alone in its cell is in no other text
            seen = of > 0
            values, of, owner = values[seen], of[seen], owner[seen]
            left = np.bincount(owner, minlength=len(k))
            most = np.maximum(posted(sizes) - (sizes - left), np.minimum(posted(sizes), np.ceil(SHARED * left).astype(np.int64)))
            order = np.lexsort((values, of, owner))
            chosen = order[_place(owner[order], len(k)) < most[owner[order]]]
            values, owner = values[chosen], owner[chosen]
            order = np.lexsort((values, owner))
            values, owner = values[order].view(np.uint64), owner[order]
            reach = np.maximum(REACH, -(-KEYS // np.maximum(1, np.bincount(owner, minlength=len(k)))))[owner]
            for j in range(1, len(values)):
                at = np.flatnonzero((owner[j:] == owner[:-j]) & (reach[j:] >= j))
                if not len(at):
                    break
                key = _mix(_mix(values[at]) + values[at + j])
                own = (key >> np.uint64(32)) % np.uint64(turns) == turn
                yield pa.RecordBatch.from_arrays([pa.array(k[owner[at[own]]]), pa.array(key[own].view(np.int64))], names=["k", "l"])

    return classes.select("k", "sketch").mapInArrow(run, "k bigint, l bigint")


def _place(owner: np.ndarray, n: int) -> np.ndarray:
    """Places, from 0, within each run of an owner (ascending)."""
    counts = np.bincount(owner, minlength=n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _lists(classes: DataFrame) -> DataFrame:
    """a, b: class pairs that meet in an inverted list, once per list."""
    return _meetings(materialise(postings(classes, _levels(classes)), "postings"))


def _meetings(post: DataFrame) -> DataFrame:
    """The meetings of the postings' lists."""
    # lists are never gathered: a list of any length is joined with itself, and a hot one is split by the join
    return post.select(F.col("k").alias("a"), "l").join(post.select(F.col("k").alias("b"), "l"), "l").where("a < b").select("a", "b")


def _short_meetings(classes: DataFrame) -> DataFrame:
    """a, b: classes of which one has few values, with a value in common."""
    few = materialise(classes.where(F.size("sketch") <= SHORT).select("k", F.explode("sketch").alias("l")), "few")
    every = classes.select("k", F.explode("sketch").alias("l"))
    wanted = few.select("l").distinct()
    # the values of all others are moved only if those of short texts are too many to say so everywhere
    if few.count() <= MOST_SENT:
        every = every.join(F.broadcast(wanted), "l", "left_semi")
    met = few.select(F.col("k").alias("x"), "l").join(every.select(F.col("k").alias("y"), "l"), "l").where("x != y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_classes(classes: DataFrame, texts: DataFrame, accept: Callable[[str, str], bool]) -> DataFrame:
    """a, b of every pair of classes (k, sketch) with enough in common that ``accept`` confirms on their texts (k, text)."""
    level = _levels(classes)
    # the lists are shuffled in turns, so that not all of them are on disk at once
    count = lambda df, n: df.groupBy("a", "b").agg(n.alias("n"))
    turns = [materialise(count(_meetings(postings(classes, level, i, TURNS)), F.count("*")), "turn") for i in range(TURNS)]
    often = count(reduce(DataFrame.union, turns), F.sum("n")).where(F.col("n") >= LISTS).select("a", "b")
    met = materialise(often.union(_short_meetings(classes)).distinct(), "met")
    for x in turns:
        drop(x)
    pairs = _with(met, classes.select("k", "sketch"), "sketch", "s")
    small = F.least(F.size("sa"), F.size("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    # cheap necessary condition before the union sketch: enough values in common at all
    pairs = pairs.where((both >= ESTIMATE * F.greatest(small, F.lit(1))) & ((both >= MEETINGS) | (small <= SHORT)))

    @F.pandas_udf("boolean")
    def estimated(sa: pd.Series, sb: pd.Series) -> pd.Series:
        return pd.Series([union_estimate(x.view(np.uint64), y.view(np.uint64)) >= ESTIMATE for x, y in zip(sa, sb)], dtype=bool)

    near = materialise(pairs.where(estimated("sa", "sb")).select("a", "b"), "near")
    drop(met)
    full = _with(near, texts, "text", "t")

    @F.pandas_udf("boolean")
    def confirmed(ta: pd.Series, tb: pd.Series) -> pd.Series:
        every = sorted({*ta, *tb})
        number = {t: i for i, t in enumerate(every)}
        hashes, offsets = shingle_hashes(every)
        own = [hashes[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        enough = [_jaccard(own[number[x]], own[number[y]]) >= JACCARD for x, y in zip(ta, tb)]
        _sentences.add({t for x, y, e in zip(ta, tb, enough) if e for t in (x, y)})
        return pd.Series([e and accept(x, y) for x, y, e in zip(ta, tb, enough)], dtype=bool)

    return full.where(confirmed("ta", "tb")).select("a", "b").distinct()


#: Pairs up to which their keys are sent to all tasks to pick the rows that are wanted.
MOST_SENT = 1_000_000


def _with(pairs: DataFrame, rows: DataFrame, column: str, name: str) -> DataFrame:
    """The pairs with a column of both members; only rows that some pair wants are moved, if the pairs are few enough to say so everywhere."""
    if pairs.count() <= MOST_SENT:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        rows = rows.join(F.broadcast(wanted), "k", "left_semi")
    a, b = (rows.select(F.col("k").alias(x), F.col(column).alias(f"{name}{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b")


def without(rows: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """The rows without some keys; rows are moved only if the keys are too many to say so everywhere."""
    keys = materialise(keys.distinct(), "dropped")
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_SENT else keys, key, "left_anti")


def _same_article(a: str, b: str) -> bool:
    return shared_sentences(a, b) >= SHARE - 1e-9


def same_article_links(pages: DataFrame, excluded: DataFrame, key: str = "zeilen_nr", blocks: str = "absaetze", title: str = "titel_original") -> tuple[DataFrame, DataFrame]:
    """(k, class, size of every row; a, b of every pair of classes with the same article); a class is a group of exact copies."""
    # the texts are written once and never shuffled; classes, lists and links move keys and sketches only
    art = materialise(articles(pages, key, blocks, title), "articles")
    out = excluded.select(F.col(key).cast("bigint").alias("k")).distinct()
    keys = art.groupBy("k").agg(F.min("digest").alias("digest")).join(out, "k", "left_anti")
    groups = keys.groupBy("digest").agg(F.min("k").alias("class"), F.count("*").alias("size"))
    of = materialise(keys.join(groups, "digest").drop("digest"), "classes")
    classes = without(art.select("k", "sketch"), art.select("k").join(of.where("k = class").select("k"), "k", "left_anti"))
    return of, materialise(similar_classes(classes, art.select("k", "text"), _same_article), "links")


def same_article_pairs(pages: DataFrame, excluded: DataFrame, key: str = "zeilen_nr", blocks: str = "absaetze", title: str = "titel_original") -> DataFrame:
    """key_a < key_b of all rows with the same article; rows in ``excluded`` form no pairs."""
    of, links = same_article_links(pages, excluded, key, blocks, title)
    a, b = of.select(F.col("k").alias("x"), F.col("class").alias("a")), of.select(F.col("k").alias("y"), F.col("class").alias("b"))
    across = links.join(a, "a").join(b, "b").select("x", "y")
    copies = of.where("size > 1")
    within = copies.select(F.col("k").alias("x"), "class").join(copies.select(F.col("k").alias("y"), "class"), "class").where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def same_article_groups(pages: DataFrame, excluded: DataFrame, key: str = "zeilen_nr", blocks: str = "absaetze", title: str = "titel_original") -> DataFrame:
    """key, klasse (smallest row of its exact copies), kopien, verweise (classes with the same article): one row per row with an article."""
    of, links = same_article_links(pages, excluded, key, blocks, title)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return of.join(ends, "class", "left").select(F.col("k").alias(key), F.col("class").alias("klasse"), F.col("size").alias("kopien"), F.coalesce("n", F.lit(0)).alias("verweise"))
