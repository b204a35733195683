"""Events told by several records: actors, pair verdicts, memory of earlier events, evidence of sentences.

Pairs meet through a shared actor inside a bucket of time, so the join is an
equi-join and no list holds more than the records of one actor in a few days.

Defined results: null titles have no words, actors or numbers and meet nobody;
records without time meet nobody; a record repeated under its key counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.functions import text as T
from quellwerk.session import drop, materialise

HOURS = 72
SAME, SAME_WITH_NUMBER, GREY = 0.5, 0.16, 0.12
#: Capitalised words that name nobody.
NO_ACTOR = ("press", "news", "update", "neue", "nuevas", "nouvelles", "nuove", "frequenze", "frequenzen", "aukcja", "subasta", "veiling")


def actors(title: Column, operator: Column) -> Column:
    """Sorted stems of the capitalised words of a title and of the operator's name, without words that name nobody."""
    words = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"(\p{Lu}[\p{L}\p{N}]{2,})"), 1)
    named = F.split(F.coalesce(operator, F.lit("")), r"[^\p{L}\p{N}]+")
    low = F.transform(F.concat(words, F.filter(named, lambda w: F.length(w) > 2)), T.low)
    return F.array_sort(F.array_distinct(F.transform(F.filter(low, lambda w: ~w.isin(*NO_ACTOR)), T.stem)))


def overlap(a: Column, b: Column) -> Column:
    """Words in common against the smaller set; null if one is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))


def described(rows: DataFrame, key: str, title: str, operator: str, time: str) -> DataFrame:
    """key, betreiber, zeit, woerter, akteure, zahlen of every record with a time."""
    return rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("k"), F.col(operator).alias("betreiber"), F.col(time).alias("zeit"),
        T.tokens(F.col(title), 4).alias("woerter"), actors(F.col(title), F.col(operator)).alias("akteure"), T.numbers(F.col(title)).alias("zahlen"),
    )


def near_pairs(left: DataFrame, right: DataFrame, hours: int = HOURS) -> DataFrame:
    """Pairs (columns _a, _b) of described records that share an actor, b not later than a and at most so many hours before it."""
    seconds = lambda c: F.unix_timestamp(F.col(c))
    span = hours * 3600
    a = left.withColumn("akteur", F.explode("akteure")).withColumn("eimer", F.explode(F.array(*[F.floor(seconds("zeit") / span) - i for i in (0, 1)])))
    b = right.withColumn("akteur", F.explode("akteure")).withColumn("eimer", F.floor(seconds("zeit") / span))
    a = a.select([F.col(c).alias(f"{c}_a") if c not in ("akteur", "eimer") else F.col(c) for c in a.columns])
    b = b.select([F.col(c).alias(f"{c}_b") if c not in ("akteur", "eimer") else F.col(c) for c in b.columns])
    met = a.join(b, ["akteur", "eimer"]).where((F.col("k_a") != F.col("k_b")) & (F.col("zeit_b") <= F.col("zeit_a")) & (F.unix_timestamp("zeit_a") - F.unix_timestamp("zeit_b") <= span))
    # a pair may share several actors: one of them, the first, speaks for it
    return met.where(F.col("akteur") == F.array_min(F.array_intersect("akteure_a", "akteure_b"))).drop("akteur", "eimer")


def verdict(pairs: DataFrame) -> DataFrame:
    """The pairs with aehnlich, gemeinsame_zahl, urteil (gleich, grau, verschieden) and rang (what a reader should look at first)."""
    sim = F.coalesce(overlap(F.col("woerter_a"), F.col("woerter_b")), F.lit(0.0))
    number = F.arrays_overlap("zahlen_a", "zahlen_b")
    other = F.col("betreiber_a") != F.col("betreiber_b")
    what = F.when(F.coalesce(other, F.lit(False)), "verschieden").when((sim >= SAME) | number & (sim >= SAME_WITH_NUMBER), "gleich").when(sim >= GREY, "grau").otherwise("verschieden")
    rank = sim + 0.25 * number.cast("int") + 0.1 * (F.size(F.array_intersect("akteure_a", "akteure_b")) - 1)
    return pairs.select("*", F.round(sim, 6).alias("aehnlich"), number.alias("gemeinsame_zahl"), what.alias("urteil"), F.round(rank, 6).alias("rang"))


def _mask(codes: Column) -> Column:
    """A long with a bit set for every code, by its last six bits; null for null."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", one, c.cast("int"))))


def _places(rows: DataFrame, values: str, most: int, slots: int = 4096) -> Callable[[Column], Column]:
    """Of a value: its place, from 1, among those that most rows hold, else 0.

    So many values are all that goes to the driver; of two in one slot of the table only the more frequent has a place.
    """
    slot = lambda v: F.pmod(F.hash(v), F.lit(slots))
    counts = rows.select(F.explode(values).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    first = {r.slot: r for r in reversed(counts.orderBy(F.col("n").desc(), "v").limit(most).withColumn("slot", slot(F.col("v"))).collect())}
    held = sorted(first.values(), key=lambda r: (-r.n, r.v))
    place = {r.slot: i for i, r in enumerate(held, 1)}
    table = F.split(F.lit(",".join(str(place.get(i, 0)) for i in range(slots))), ",").cast("array<int>")
    names = F.array(F.lit(""), *[F.lit(r.v) for r in held])
    at = lambda v: F.get(table, slot(v))
    return lambda v: F.when((at(v) > 0) & (F.get(names, at(v)) == v), at(v)).otherwise(0)


def judged(rows: DataFrame, hours: int = HOURS, longs: int = 3) -> DataFrame:
    """k_a, k_b, aehnlich, gemeinsame_zahl, urteil: ``verdict`` of all ``near_pairs`` of described records, one a key, among themselves.

    Nearly all time goes into the pairs, so their sets are compared as bits.  Each of the 64 * ``longs`` most frequent words
    has a bit of its own, and those in common are counted exactly; of the others, and of the numbers, a bit of their hash
    tells most pairs that have none in common, and only the rest compare the arrays.  The first common actor speaks for a
    pair: frequent ones come first, so a posting holds what comes before its actor.
    """
    span, most = hours * 3600, 16
    none = F.lit(0).cast("bigint")
    hashed = lambda c: _mask(F.transform(c, lambda x: F.hash(x)))
    within = lambda least: lambda p: (p > least) & (p <= least + 64)
    told = materialise(rows.withColumn("nr", F.monotonically_increasing_id()), "told")
    words, names = _places(told, "woerter", 64 * longs), _places(told, "akteure", 64)
    placed = told.select("*", F.transform("woerter", words).alias("at"), F.transform("akteure", lambda x: F.struct(x.alias("akteur"), names(x).alias("p"))).alias("alle"))
    coded = placed.select(
        "nr", "k", "betreiber", "zeit", F.unix_timestamp("zeit").alias("sekunde"), "zahlen", hashed("zahlen").alias("z"), F.coalesce(F.size("woerter"), F.lit(0)).alias("n"),
        *[F.coalesce(_mask(F.filter("at", within(64 * i))), none).alias(f"w{i}") for i in range(longs)], F.filter("woerter", lambda w, i: F.get("at", i) == 0).alias("selten"), "alle",
    )
    x = F.col("x")
    before = F.filter("alle", lambda y: (y["p"] > 0) & ((x["p"] == 0) | (y["p"] < x["p"])))
    others = F.filter("alle", lambda y: (y["p"] == 0) & (x["p"] == 0) & (y["akteur"] < x["akteur"]))
    posted = coded.withColumn("s", F.coalesce(hashed("selten"), none)).withColumn("x", F.explode("alle"))
    posted = posted.withColumns({"v": _mask(F.transform(before, lambda y: y["p"])), "davor": F.transform(others, lambda y: y["akteur"]), "akteur": x["akteur"], "oft": x["p"] > 0}).drop("alle", "x")
    posted = materialise(posted.withColumn("d", hashed("davor")), "posted")
    drop(told)

    bucket = F.floor(F.col("sekunde") / span)
    side = lambda df, x: df.select([F.col(c).alias(f"{c}_{x}") if c not in ("akteur", "eimer") else F.col(c) for c in df.columns])
    both = lambda c: F.col(f"{c}_a").bitwiseAND(F.col(f"{c}_b"))
    near = (F.col("zeit_b") <= F.col("zeit_a")) & (F.col("sekunde_b") >= F.col("ab_a")) & (F.col("nr_a") != F.col("nr_b"))
    seldom = F.when(both("s") == 0, 0).otherwise(F.size(F.array_intersect("selten_a", "selten_b")))
    number = F.when(both("z") == 0, False).when(both("z").isNotNull(), F.arrays_overlap("zahlen_a", "zahlen_b"))
    same = sum((F.bit_count(both(f"w{i}")) for i in range(longs)), seldom)
    counted = ["k_a", "k_b", F.coalesce(F.col("betreiber_a") != F.col("betreiber_b"), F.lit(False)).alias("anders"), same.alias("c"), F.least("n_a", "n_b").alias("m"), number.alias("gemeinsame_zahl")]
    # rounding costs more than all the rest of a pair: the quotients of small sets stand in a table
    table = F.array(*[F.round(F.lit(c) / F.lit(max(m, 1)), 6) for m in range(most + 1) for c in range(most + 1)])
    sim = F.when(F.col("m") == 0, 0.0).otherwise(F.col("c") / F.col("m"))
    rounded = F.when(F.col("m") <= most, F.get(table, F.col("m") * (most + 1) + F.col("c"))).otherwise(F.round(F.col("c") / F.col("m"), 6))
    what = F.when(F.col("anders"), "verschieden").when((F.col("sim") >= SAME) | F.col("gemeinsame_zahl") & (F.col("sim") >= SAME_WITH_NUMBER), "gleich").when(F.col("sim") >= GREY, "grau").otherwise("verschieden")

    def told_of(part: DataFrame, first: Column) -> DataFrame:
        a = part.withColumns({"ab": F.col("sekunde") - span, "eimer": F.explode(F.array(bucket, bucket - 1))})
        met = side(a, "a").join(side(part.withColumn("eimer", bucket), "b"), ["akteur", "eimer"]).where(near & first)
        return met.select(*counted).withColumns({"sim": sim, "aehnlich": rounded}).select("k_a", "k_b", "aehnlich", "gemeinsame_zahl", what.alias("urteil"))

    # nothing but frequent actors comes before a frequent one, so its pairs, nearly all, read no array to be met
    rest = (both("v") == 0) & ((both("d") == 0) | ~F.arrays_overlap("davor_a", "davor_b"))
    return told_of(posted.where("oft"), both("v") == 0).union(told_of(posted.where("not oft"), rest))


def remembered(new: DataFrame, stored: DataFrame, hours: int = HOURS) -> DataFrame:
    """k, ereignis: for every new record the earliest stored one of the same event within the hours before it; only hits."""
    judged = verdict(near_pairs(new, stored, hours)).where("urteil = 'gleich'")
    return judged.groupBy(F.col("k_a").alias("k")).agg(F.min(F.struct("zeit_b", "k_b"))["k_b"].alias("ereignis"))


def _same(hours: int) -> Column:
    """Of a pair (columns _a, _b): k_b is another record of the event of k_a, as ``near_pairs`` and ``verdict`` have it."""
    smaller = F.nullif(F.least(F.size("woerter_a"), F.size("woerter_b")), F.lit(0))
    apart = F.unix_timestamp("zeit_a") - F.unix_timestamp("zeit_b")
    told = (F.col("k_a") != F.col("k_b")) & (F.col("zeit_b") <= F.col("zeit_a")) & (apart <= hours * 3600) & ~F.coalesce(F.col("betreiber_a") != F.col("betreiber_b"), F.lit(False))
    least = F.when(F.arrays_overlap("zahlen_a", "zahlen_b"), SAME_WITH_NUMBER).otherwise(SAME)
    return told & F.arrays_overlap("akteure_a", "akteure_b") & (F.size(F.array_intersect("woerter_a", "woerter_b")) / smaller >= least)


def apart(df: DataFrame) -> DataFrame:
    """Rows that a join must not send to the driver: written keys are many times larger in memory than their files, by which Spark decides."""
    return df.hint("merge")


def attached(rows: DataFrame, hours: int = HOURS, last: int = 6) -> DataFrame:
    """k: the described records (read several times) that ``remembered`` would find among themselves, without forming all their pairs.

    Most records attach to one of the last few of their operator with a word in common, which a window finds.  For the
    others every record of the same event is met: one with a number in common by that number, and one with half of the
    smaller set of words by a word.  As so many of the smaller set's n words are common, one of its n div 2 + 1 rarest is.
    """
    fields = [c for c in rows.columns if c != "k"]
    side = lambda df, x: df.select([F.col(c).alias(f"{c}_{x}") if c in rows.columns else F.col(c) for c in df.columns])
    span = hours * 3600
    day = F.floor(F.unix_timestamp("zeit") / span)
    words = rows.withColumn("w", F.explode("woerter"))
    window = Window.partitionBy("betreiber", "w").orderBy("zeit", "k")
    held = words.select("w", F.struct("k", *fields).alias("a"), *[F.lag(F.struct("k", *fields), i).over(window).alias(f"b{i}") for i in range(1, last + 1)])
    each = held.select("a", F.explode(F.array(*[f"b{i}" for i in range(1, last + 1)])).alias("b")).where("b is not null")
    flat = each.select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in rows.columns])
    near = materialise(flat.where(_same(hours)).select(F.col("k_a").alias("k")).distinct(), "near")
    rest = rows.join(apart(near), "k", "left_anti")

    both = lambda df: side(df.withColumn("eimer", F.explode(F.array(day, day - 1))), "a")
    number = lambda df: df.withColumn("zahl", F.explode("zahlen"))
    met = both(number(rest)).join(apart(side(number(rows).withColumn("eimer", day), "b")), ["zahl", "eimer"]).where(_same(hours))
    met = materialise(met.select(F.col("k_a").alias("k")).distinct(), "met")

    often = words.groupBy("w").agg(F.count("*").alias("n"))
    order = words.select("k", "w").join(apart(often), "w").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("ordered"))
    ordered = materialise(rows.join(apart(order), "k"), "ordered")
    rarest = F.slice("ordered", 1, F.floor(F.size("ordered") / 2).cast("int") + 1)
    post = lambda df, which: df.withColumn("w", F.explode(which)).drop("ordered")
    left = materialise(ordered.join(apart(near.union(met)), "k", "left_anti"), "left")
    smaller = F.size("woerter_a") <= F.size("woerter_b")
    one = both(post(left, rarest)).join(apart(side(post(ordered, "ordered").withColumn("eimer", day), "b")), ["w", "eimer"]).where(smaller & _same(hours))
    # written, so that its shuffle is gone before the next one begins
    one = materialise(one.select(F.col("k_a").alias("k")).distinct(), "one")
    other = both(post(left.join(apart(one), "k", "left_anti"), "ordered")).join(apart(side(post(ordered, rarest).withColumn("eimer", day), "b")), ["w", "eimer"]).where(~smaller & _same(hours))
    return reduce(DataFrame.union, [near, met, one, other.select(F.col("k_a").alias("k"))]).distinct()


def evidence(sentences: DataFrame, records: DataFrame, most: int = 4) -> DataFrame:
    """tag, satz, k, gewicht: records that share at least two rare words of their day with a sentence.

    ``sentences``: tag, satz, woerter; ``records``: tag, k, woerter.  A word is rare if at most max(2, n div 8) of the
    day's n records have it; a record belongs to its best sentence only, and a sentence keeps its best few records.
    """
    words = records.select("tag", "k", F.explode("woerter").alias("w"))
    n = records.groupBy("tag").agg(F.count("*").alias("n"))
    df = words.groupBy("tag", "w").agg(F.count("*").alias("df")).join(n, "tag").where(F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("n") / 8)))
    rare = words.join(df.select("tag", "w", "df"), ["tag", "w"])
    met = sentences.select("tag", "satz", F.explode("woerter").alias("w")).join(rare, ["tag", "w"])
    weight = met.groupBy("tag", "satz", "k").agg(F.count("*").alias("c"), F.round(F.sum(1 / F.col("df")), 6).alias("gewicht")).where("c >= 2")
    own = weight.groupBy("tag", "k").agg(F.max_by(F.struct("satz", "gewicht"), F.struct("gewicht", F.col("satz"))).alias("b")).select("tag", "b.satz", "k", "b.gewicht")
    w = Window.partitionBy("tag", "satz").orderBy(F.col("gewicht").desc(), "k")
    return own.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def phrases(text: Column, longest: int) -> Column:
    """array<struct<start, n, p>>: every run of up to so many words of a text, with its place and number of words."""
    words = F.filter(F.split(T.low(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    at = lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice(words, i, n), " ").alias("p")))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), at))
    return F.filter(runs, lambda r: (r["start"] + r["n"] - 1 <= F.size(words)) & (r["p"] != ""))


def mentions(rows: DataFrame, key: Column, text: Column, names: DataFrame, name: str, longest: int = 4) -> DataFrame:
    """k, name, start, n, danach (the word after it): every place where a text names one of the names; an equi-join on word runs."""
    words = F.filter(F.split(T.low(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = rows.select(key.alias("k"), F.explode(phrases(text, longest)).alias("r"), words.alias("w"))
    runs = runs.select("k", "r.start", "r.n", "r.p", F.try_element_at("w", F.col("r.start") + F.col("r.n")).alias("danach"))
    form = F.array_join(F.filter(F.split(T.low(F.col(name)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    held = names.where(F.col(name).isNotNull()).select(form.alias("p"), F.col(name).alias("name")).where("p != ''").groupBy("p").agg(F.min("name").alias("name"))
    return runs.join(held, "p").select("k", "name", "start", "n", "danach")


def recognised(found: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """k, name: the longest name of each text, the first among equals; a name followed by a model suffix is another one."""
    sure = found.where(~F.coalesce(F.col("danach").isin(*suffixes), F.lit(False)))
    return sure.groupBy("k").agg(F.max_by("name", F.struct("n", -F.col("start"), "name")).alias("name"))
