"""Similarity joins and clusters on token sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.session import materialise


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient: shared tokens over the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def overlap_pairs(rows: DataFrame, key: str, tokens: Column, when: str, hours: int, least: float, least_df: int, most_df: int) -> DataFrame:
    """a < b and deckung of all pairs that share a token of the given document frequency, lie near in time and overlap enough.

    Pairs meet in the inverted list of a shared token; lists of more than ``most_df``
    rows are no evidence of one event, that is the rarity filter, so a list is bounded.
    """
    t = rows.select(F.col(key).alias("k"), F.col(when).alias("p"), tokens.alias("ws"))
    e = t.select("k", F.explode("ws").alias("wort"))
    rare = e.groupBy("wort").agg(F.count("*").alias("df")).where(F.col("df").between(least_df, most_df)).select("wort")
    lists = e.join(rare, "wort").groupBy("wort").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    pairs = F.flatten(F.transform("ks", lambda x, i: F.transform(F.slice("ks", i + 2, most_df), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    met = lists.select(F.inline(pairs)).where("a < b").distinct()
    a, b = (t.select(F.col("k").alias(n), F.col("p").alias(f"p{n}"), F.col("ws").alias(f"w{n}")) for n in "ab")
    near = F.col("pa").isNull() | F.col("pb").isNull() | (F.abs(F.unix_micros(F.col("pa").cast("timestamp")) - F.unix_micros(F.col("pb").cast("timestamp"))) <= hours * 3_600_000_000)
    out = met.join(a, "a").join(b, "b").where(near).withColumn("d", overlap(F.col("wa"), F.col("wb"))).where(F.col("d") >= least)
    return out.select("a", "b", F.round("d", 4).alias("deckung"))


#: Parts into which the lists of rows without a time are divided, as they meet rows of all times.
PARTS = 16


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with a number that ascends in the given order: short keys for pairs."""
    return materialise(rows.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")


def all_overlap_pairs(rows: DataFrame, key: str, tokens: Column, when: str, hours: int, least: float) -> DataFrame:
    """a < b and deckung of all pairs near in time that overlap enough, however frequent the shared tokens are.

    The smaller set of such a pair shares so many tokens that one is among its rarest
    (prefix filter): those meet all tokens of the larger set, in time buckets as wide as
    the window, so a list grows with the rows of a window and none is cut. A pair counts
    where it meets in its rarest shared token.
    """
    t = rows.select(F.col(key).alias("k"), F.unix_micros(F.col(when).cast("timestamp")).alias("p"), tokens.alias("ws"))
    e = t.select("k", "p", F.explode(F.array_distinct("ws")).alias("wort"))
    words = numbered(e.groupBy("wort").agg(F.count("*").alias("df")), ["df", "wort"], "w").select("wort", "w")
    sets = materialise(e.join(words, "wort").groupBy("k", "p").agg(F.array_sort(F.collect_list("w")).alias("ws")), "sets")
    b0, part, m = F.floor(F.col("p") / (hours * 3_600_000_000)), F.pmod(F.hash("k"), F.lit(PARTS)).cast("bigint"), F.size("ws")
    # where a row looks and where it is found: kind 0 by time, 1 timed rows for untimed ones, 2 untimed rows for all
    place = lambda kind, at: F.struct(F.lit(kind), at).cast("struct<kind:int,at:bigint>")
    every = lambda kind: F.array(*[place(kind, F.lit(i)) for i in range(PARTS)])
    looks = F.when(F.col("p").isNull(), every(2)).otherwise(F.array(*[place(0, b0 + d) for d in (-1, 0, 1)], place(1, part)))
    found = F.when(F.col("p").isNull(), F.concat(every(1), F.array(place(2, part)))).otherwise(F.array(place(0, b0), place(2, part)))
    rarest = F.slice("ws", 1, m - F.greatest(F.ceil(m * least - 1e-9).cast("int"), F.lit(1)) + 1)
    a = sets.select(F.col("k").alias("ka"), F.col("p").alias("pa"), F.col("ws").alias("wa"), F.explode(rarest).alias("w"), looks.alias("x")).select("ka", "pa", "wa", "w", F.inline("x"))
    b = sets.select(F.col("k").alias("kb"), F.col("p").alias("pb"), F.col("ws").alias("wb"), F.explode("ws").alias("w"), found.alias("x")).select("kb", "pb", "wb", "w", F.inline("x"))
    na, nb, both = F.size("wa"), F.size("wb"), F.array_intersect("wa", "wb")
    smaller = (na < nb) | ((na == nb) & (F.col("ka") < F.col("kb")))
    near = F.col("pa").isNull() | F.col("pb").isNull() | (F.abs(F.col("pa") - F.col("pb")) <= hours * 3_600_000_000)
    met = a.join(b, ["w", "kind", "at"]).where(smaller & near).where((F.get(both, F.lit(0)) == F.col("w")) & (F.size(both) / na >= least))
    return met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), F.round(F.size(both) / na, 4).alias("deckung"))


#: Edges that are decided on the driver when rounds have left no more.
FEW = 100_000


def stars(rows: DataFrame, pairs: DataFrame, key: str, when: str, most: int) -> DataFrame:
    """key, kopf of greedy star clusters: freshest first, each row is a head or joins its best head, at most ``most`` to a head.

    A row is a head if none of its fresher neighbours is, which gives the sequential
    result. In a round every row without undecided fresher neighbours becomes a head and
    the neighbours of the new heads are members; rounds go on until at most FEW edges are
    left, which are decided in the same way on the driver.
    """
    rank = F.struct(F.coalesce(F.unix_micros(F.col(when).cast("timestamp")), F.lit(-(2**62))).alias("p"), F.col(key).alias("k"))
    ranked = rows.select(F.col(key).alias("k"), rank.alias("r"))
    a, b = (ranked.select(F.col("k").alias(n), F.col("r").alias(f"r{n}")) for n in "ab")
    fresher = F.col("ra") > F.col("rb")
    edges = pairs.join(a, "a").join(b, "b").select(F.when(fresher, F.col("b")).otherwise(F.col("a")).alias("k"), F.when(fresher, F.col("a")).otherwise(F.col("b")).alias("o"), F.col("deckung").alias("d"))
    edges = materialise(edges, "edges")
    left = edges.select("k", "o")  # undecided rows and their fresher neighbours that are no members
    new = materialise(ranked.select("k").join(left.select("k"), "k", "left_anti"), "heads")
    heads = new
    while left.count() > FEW:
        members = materialise(left.join(new.withColumnRenamed("k", "o"), "o", "left_semi").select("k").distinct(), "members")
        after = left.join(members, "k", "left_anti").join(members.withColumnRenamed("k", "o"), "o", "left_anti").select("k", "o")
        after = materialise(after, "left")
        new = left.select("k").distinct().join(members, "k", "left_anti").join(after.select("k"), "k", "left_anti")
        new = materialise(new, "heads")
        heads = materialise(heads.union(new), "heads")
        left = after
    # few edges left: the same rule row by row, freshest first
    rest = left.join(new.select(F.col("k").alias("o"), F.lit(True).alias("head")), "o", "left").join(ranked, "k").select("k", "o", "head", "r").collect()
    if rest:
        leads, fresher_of = {x.o for x in rest if x.head}, {}
        for x in rest:
            fresher_of.setdefault((x.r, x.k), []).append(x.o)
        own = []
        for (_, k), os in sorted(fresher_of.items(), reverse=True):
            if leads.isdisjoint(os):
                leads.add(k)
                own.append((k,))
        heads = materialise(heads.union(rows.sparkSession.createDataFrame(own, heads.schema)), "heads")
    best = edges.join(heads.join(ranked, "k").select(F.col("k").alias("o"), F.col("r").alias("ro")), "o").groupBy("k").agg(F.max(F.struct("d", "ro", "o")).alias("m"))
    done = materialise(heads.select("k", F.col("k").alias("kopf")).union(best.select("k", F.col("m.o").alias("kopf"))), "stars")
    # members beyond the cap are heads of their own, the freshest stay
    w = Window.partitionBy("kopf").orderBy((F.col("k") != F.col("kopf")).cast("int"), F.col("r").desc())
    sized = done.join(ranked, "k").withColumn("n", F.row_number().over(w))
    return sized.select(F.col("k").alias(key), F.when(F.col("n") <= most, F.col("kopf")).otherwise(F.col("k")).alias("kopf"))


def fuzzy_upsert(new: DataFrame, known: DataFrame, block: str, key: str, words: str, known_key: str, known_words: str, least: float) -> DataFrame:
    """key and the known row of its block with the best overlap of at least so much, or null for an insert; ties take the smaller key."""
    # rows meet in a word they share, never all rows of a block
    size = lambda c: F.size(F.array_distinct(c))
    a = new.select(block, key, size(words).alias("_a"), F.explode(F.array_distinct(words)).alias("_w"))
    b = known.select(block, known_key, size(known_words).alias("_b"), F.explode(F.array_distinct(known_words)).alias("_w"))
    shared = a.join(b, [block, "_w"]).groupBy(key, known_key, "_a", "_b").agg(F.count("*").alias("_n"))
    cand = shared.withColumn("_d", F.col("_n") / F.least("_a", "_b")).where(F.col("_d") >= least)
    best = cand.groupBy(key).agg(F.min(F.struct((-F.col("_d")).alias("d"), F.col(known_key).alias("k"))).alias("m"))
    return new.select(key).join(best, key, "left").select(key, F.col("m.k").alias(known_key))
