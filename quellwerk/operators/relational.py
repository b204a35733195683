"""Set, join and ranking operators, parameterised over column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heapify, heappop
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unseen(batch: DataFrame, seen: DataFrame, key: str, order: list) -> DataFrame:
    """First row of every key that the store does not hold: keep-first inside the batch, then a left anti join."""
    w = Window.partitionBy(key).orderBy(*order)
    first = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first.join(seen.select(key).distinct(), key, "left_anti")


def fresh(rows: DataFrame, when: str, now: Column, days: float, ahead: float = 1.0) -> DataFrame:
    """Undated rows, and rows at most so many days old and not more than a day ahead."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(when).cast("timestamp"))) / F.lit(86_400_000_000.0)
    return rows.where(F.col(when).isNull() | age.between(-ahead, days))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int, rank: str = "rang") -> DataFrame:
    """First k rows per group; Spark prunes each partition to k before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def round_robin(rows: DataFrame, group: str, order: list, newest: str, k: int) -> DataFrame:
    """Interleave the groups: everyone's first, then everyone's second; groups with the newest row lead.

    Only the first k of a group can reach the first k overall, so groups are cut to k before they are mixed.
    """
    cut = top_per_group(rows, [group], order, k, "runde")
    lead = rows.groupBy(group).agg(F.max(newest).alias("_lead"))
    mixed = cut.join(lead, group)
    return mixed.orderBy("runde", F.col("_lead").desc_nulls_last(), group).limit(k).drop("_lead")


def precedence_union(frames: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Full union in which the first frame that holds a key wins."""
    tagged = [f.select(key, *columns, F.lit(i).alias("_p")) for i, f in enumerate(frames)]
    return latest(reduce(DataFrame.unionByName, tagged), [key], ["_p", *columns]).drop("_p")


def value_diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key the values that came and went, sorted; keys without a change are left out."""
    side = lambda df, c: df.where(F.col(value).isNotNull()).select(*key, value).distinct().withColumn(c, F.lit(True))
    both = side(old, "_o").join(side(new, "_n"), [*key, value], "full_outer").where("_o is null or _n is null")
    # only what changed is gathered
    pick = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col(value))))
    return both.groupBy(*key).agg(pick("_n").alias("dazu"), pick("_o").alias("weg"))


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, feld, alt, neu for every changed field of rows in both; a new null is no change."""
    o = old.select(key, *[F.col(f).cast("string").alias(f"_o{f}") for f in fields])
    n = new.select(key, *[F.col(f).cast("string").alias(f"_n{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("feld"), F.col(f"_o{f}").alias("alt"), F.col(f"_n{f}").alias("neu")) for f in fields])
    changed = F.filter(each, lambda x: x["neu"].isNotNull() & ~x["alt"].eqNullSafe(x["neu"]))
    return o.join(n, key).select(key, F.explode(changed).alias("x")).select(key, "x.*")


def longest_term(rows: DataFrame, key: str, text: str, terms: DataFrame, term: str, label: str) -> DataFrame:
    """key and label of the longest term that occurs as whole words.

    Rows and terms meet by an equi-join on the term's first word, so no row is compared with all terms.
    """
    first = lambda c: F.element_at(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), 1)
    t = terms.where(F.length(term) >= 3).select(F.lower(term).alias("_t"), F.col(label), first(F.col(term)).alias("_w")).distinct()
    padded = F.concat(F.lit(" "), F.array_join(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), " "), F.lit(" "))
    r = rows.select(key, padded.alias("_p"), F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("_w"))
    hit = r.join(t, "_w").where(F.expr("contains(_p, concat(' ', array_join(split(_t, '[^\\\\p{L}\\\\p{N}]+'), ' '), ' '))"))
    return hit.groupBy(key).agg(F.max(F.struct(F.length("_t").alias("n"), F.col("_t").alias("t"), F.col(label).alias("l"))).alias("m")).select(key, F.col("m.t").alias("begriff"), F.col("m.l").alias(label))


def as_of(left: DataFrame, right: DataFrame, key: list[str], when: str, at: str, value: str, out: str) -> DataFrame:
    """Last non-null value at or before a moment, as one union and one running window per key."""
    cols = left.columns
    l = left.select(*cols, F.col(when).alias("_t"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_s"))
    r = right.where(F.col(value).isNotNull()).select(*key, F.col(at).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_s"))
    w = Window.partitionBy(*key).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r, allowMissingColumns=True).withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_s = 1").select(*cols, out)


def near_in_time(rows: DataFrame, key: str, ident: str, when: str, hours: int) -> DataFrame:
    """Pairs of one key at most so many hours apart: rows meet in time buckets of that width, so the join is an equi-join."""
    width = hours * 3600
    a = rows.select(key, F.col(ident).alias("a"), F.unix_micros(F.col(when).cast("timestamp")).alias("ta")).withColumn("b0", F.floor(F.col("ta") / (width * 1_000_000)))
    b = rows.select(key, F.col(ident).alias("b"), F.unix_micros(F.col(when).cast("timestamp")).alias("tb")).withColumn("b0", F.explode(F.array(*[F.floor(F.col("tb") / (width * 1_000_000)) + F.lit(d) for d in (-1, 0, 1)])))
    return a.join(b, [key, "b0"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= width * 1_000_000)).select(key, "a", "b")


def best_match(offers: DataFrame, candidates: DataFrame, key: str, score: str) -> DataFrame:
    """Greedy one-to-one choice inside a key by descending score of the offers and candidates that share it."""
    return greedy_match(offers.join(candidates, key), key, score)


def greedy_match(pairs: DataFrame, key: str, score: str) -> DataFrame:
    """Greedy one-to-one choice among the pairs (angebot, bild) of a key by descending score, then by angebot and bild.

    The pairs of a key pass once in that order and a pair is taken if both sides are free,
    until no pair is left; only the sides taken in the key at hand are held.
    """
    pairs = pairs.select(key, "angebot", "bild", score).where(F.col(key).isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, offers, images = None, set(), set()
        for batch in batches:
            free = []
            for k, a, b in zip(batch[key].tolist(), batch["angebot"].tolist(), batch["bild"].tolist()):
                if k != at:
                    at, offers, images = k, set(), set()
                free.append(a not in offers and b not in images)
                if free[-1]:
                    offers.add(a)
                    images.add(b)
            yield batch[free]

    ordered = pairs.repartition(key).sortWithinPartitions(key, F.col(score).desc(), "angebot", "bild")
    return ordered.mapInPandas(run, pairs.schema)


def match_by_words(offers: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """key, angebot, bild, n: the greedy choice of ``greedy_match`` for offers (key, angebot, w) and candidates (key, bild, v)
    whose score is the number of words in common, without forming their pairs.

    Levels are passed from the most words in common down.  At level n no free pair shares more, so the pairs with n words
    in common are those that share some n of them, and the smallest free candidate of such a set is looked up.  A row of
    w words that both sides have is in 2^w sets, so rows are meant to be names of a few words; a key's rows are held in one task.
    Rows without number or key meet nobody, rows without words (null) are left to the last.
    """
    side = lambda df, ident, words, s: df.where(F.col(key).isNotNull() & F.col(ident).isNotNull()).select(key, F.lit(s).alias("s"), F.col(ident).alias("i"), F.col(words).alias("w"))
    rows = side(offers, "angebot", "w", 0).unionByName(side(candidates, "bild", "v", 1))
    ident = dict(rows.dtypes)["i"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        both = ({}, {})  # identity: the sets of words it stands with, None for no words
        for s, i, w in zip(group["s"].tolist(), group["i"].tolist(), group["w"].tolist()):
            both[s].setdefault(i, set()).add(None if w is None else frozenset(w))
        pairs = _match_levels(*both)
        at = group[key].iloc[0]
        return pd.DataFrame([(at, a, b, n) for a, b, n in pairs], columns=[key, "angebot", "bild", "n"]).astype({"n": "Int32"})

    return rows.groupBy(key).applyInPandas(run, f"{key} {dict(rows.dtypes)[key]}, angebot {ident}, bild {ident}, n int")


def _match_levels(offers: dict, images: dict) -> list[tuple]:
    """(offer, image, words in common or None) of the greedy one-to-one choice among identities with their sets of words."""
    words = lambda side: {w for sets in side.values() for x in sets if x for w in x}
    # words of one side only are in no pair
    met = {w: i for i, w in enumerate(words(offers) & words(images))}
    cut = lambda side: {i: [None if x is None else tuple(sorted(met[w] for w in x if w in met)) for x in sets] for i, sets in side.items()}
    o, m = cut(offers), cut(images)
    free_o, free_i, out = sorted(o), set(m), []

    def take(candidates: dict, sets_of: Callable, n: int | None) -> None:
        nonlocal free_o
        for heap in candidates.values():
            heapify(heap)
        left = []
        for a in free_o:
            best = None
            for c in sets_of(a):
                heap = candidates.get(c)
                while heap and heap[0] not in free_i:
                    heappop(heap)
                if heap and (best is None or heap[0] < best):
                    best = heap[0]
            if best is None:
                left.append(a)
            else:
                free_i.discard(best)
                out.append((a, best, n))
        free_o = left

    most = max((len(x) for side in (o, m) for sets in side.values() for x in sets if x is not None), default=0)
    for n in range(most, -1, -1):
        candidates: dict = {}
        for b in free_i:
            for c in {c for x in m[b] if x is not None for c in combinations(x, n)}:
                candidates.setdefault(c, []).append(b)
        take(candidates, lambda a, n=n: {c for x in o[a] if x is not None for c in combinations(x, n)}, n)
    # what has no words on one side comes last, whatever the other has
    unknown, every = [b for b in free_i if None in m[b]], list(free_i)
    take({"unknown": unknown, "every": every}, lambda a: ("every",) if None in o[a] else ("unknown",), None)
    return out
