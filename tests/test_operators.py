import random

import pytest
from pyspark.sql import functions as F

from quellwerk.operators import relational as R
from quellwerk.operators import scoring as S
from quellwerk.operators import similarity as M
from quellwerk.operators import state as ST


def test_round_robin_interleaves(spark):
    rows = spark.createDataFrame([("a", i, 100 - i) for i in range(5)] + [("b", 10 + i, 50 - i) for i in range(2)], "s string, i int, p int")
    got = [(r.s, r.i) for r in R.round_robin(rows, "s", [F.col("p").desc()], "p", 5).collect()]
    assert got == [("a", 0), ("b", 10), ("a", 1), ("b", 11), ("a", 2)]


def test_as_of_takes_the_last_known(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 3, 1.0), (1, 5, 2.0), (1, 6, 3.0), (2, 1, None)], "k int, at int, v double")
    got = {(r.k, r.t): r.x for r in R.as_of(left, right, ["k"], "t", "at", "v", "x").collect()}
    assert got == {(1, 5): 2.0, (1, 0): None, (2, 9): None}


def test_best_match_is_one_to_one(spark):
    o = spark.createDataFrame([("k", "o1"), ("k", "o2")], "k string, angebot string")
    c = spark.createDataFrame([("k", "b1"), ("k", "b2")], "k string, bild string")
    score = {("o1", "b1"): 3.0, ("o2", "b1"): 2.5, ("o1", "b2"): 1.0, ("o2", "b2"): 0.5}
    s = F.lit(None).cast("double")
    pairs = c.withColumn("x", F.lit(1))
    for (a, b), v in score.items():
        s = F.when((F.col("angebot") == a) & (F.col("bild") == b), F.lit(v)).otherwise(s)
    joined = o.join(pairs, "k").withColumn("p", s)
    got = {(r.angebot, r.bild) for r in R.best_match(joined.select("k", "angebot").distinct(), joined.select("k", "bild").distinct().withColumn("p", F.lit(1.0)), "k", "p").collect()}
    assert len({a for a, _ in got}) == len(got) == 2 and len({b for _, b in got}) == 2


def test_greedy_match_leaves_no_pair(spark):
    """A key of 70 by 80 rows, more than 50 rounds of equal scores; the result is that of the sorted loop."""
    rng = random.Random(4)
    rows = [("k", a, b, rng.choice([0.5, 0.5, 1.5])) for a in range(70) for b in range(80)] + [("l", 1, 1, 0.5), ("l", 1, 2, 2.5), ("l", 3, 2, 2.0)]
    want, done = set(), set()
    for k, a, b, p in sorted(rows, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if not {(k, "a", a), (k, "b", b)} & done:
            done |= {(k, "a", a), (k, "b", b)}
            want.add((k, a, b, p))
    df = spark.createDataFrame(rows, "k string, angebot int, bild int, p double")
    got = {tuple(r) for r in R.greedy_match(df, "k", "p").collect()}
    assert got == want and len(got) == 71
    same = R.best_match(df.where("k = 'k'").select("k", "angebot").distinct(), df.where("k = 'k'").select("k", "bild").distinct().withColumn("p", F.lit(1.0)), "k", "p")
    assert same.count() == 70


def test_match_by_words_is_the_greedy_choice_of_all_pairs(spark, tmp_path):
    """Keys of unequal sides, repeated identities, empty and missing words; no pair is formed by the operator or the query."""
    rng = random.Random(6)
    words = lambda: rng.choice([None, [], *[rng.sample("abcdef", rng.randrange(1, 5)) for _ in range(20)]])
    offers = spark.createDataFrame([(rng.choice("xyz"), rng.randrange(60), words()) for _ in range(120)] + [(None, 1, ["a"])], "k string, angebot bigint, w array<string>")
    images = spark.createDataFrame([(rng.choice("xxy"), rng.randrange(50), words()) for _ in range(90)] + [(None, 1, ["a"])], "k string, bild bigint, v array<string>")
    pairs = offers.join(images, "k").withColumn("n", F.size(F.array_intersect("w", "v")))
    got, want = R.match_by_words(offers, images, "k"), R.greedy_match(pairs, "k", "n")
    assert sorted(got.collect(), key=str) == sorted(want.select(*got.columns).collect(), key=str) and got.count() > 40
    from quellwerk.plans import registry

    spark.createDataFrame([(i, "rot bolt", "B", 1 + i % 50) for i in range(200)], "p_partkey bigint, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = registry()[0]["c19_greedy_matching"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 100


def test_all_overlap_pairs_keep_frequent_words(spark):
    """Every title holds a frequent word and some have no time; the pairs are those of the plain double loop."""
    rng = random.Random(5)
    rows = [(k, rng.choice([None, *range(0, 400)]) if k % 9 else None, sorted(rng.sample(["oft", "viel", "stets", "mal"], rng.randrange(1, 4))) + rng.sample([f"w{i}" for i in range(30)], rng.randrange(0, 4))) for k in range(240)]
    want = set()
    for x in rows:
        for y in rows:
            n = len(set(x[2]) & set(y[2])) / min(len(x[2]), len(y[2]))
            if x[0] < y[0] and n >= 0.5 and (x[1] is None or y[1] is None or abs(x[1] - y[1]) <= 72):
                want.add((x[0], y[0], round(n, 4)))
    df = spark.createDataFrame(rows, "k bigint, h int, ws array<string>").withColumn("p", F.timestamp_seconds(F.col("h") * 3600))
    got = [(r.a, r.b, r.deckung) for r in M.all_overlap_pairs(df, "k", F.col("ws"), "p", 72, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    capped = M.overlap_pairs(df, "k", F.col("ws"), "p", 72, 0.5, 2, 50).count()
    assert capped < len(want)


def test_stars_equal_the_sequential_rule(spark):
    rng = random.Random(3)
    n = 40
    edges = {(a, b): round(rng.choice([0.5, 0.75, 1.0]), 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08}
    order = sorted(range(n), key=lambda k: (k % 7, k), reverse=True)
    head = {}
    for pos, k in enumerate(order):
        best = None
        for o in order[:pos]:
            d = edges.get((min(k, o), max(k, o)))
            if d is not None and head[o] == o:
                best = max(best, (d, (o % 7, o))) if best else (d, (o % 7, o))
        head[k] = best[1][1] if best else k
    rows = spark.createDataFrame([(k, k % 7) for k in range(n)], "k bigint, d int").select("k", F.timestamp_seconds(F.col("d")).alias("p"))
    pairs = spark.createDataFrame([(a, b, d) for (a, b), d in edges.items()], "a bigint, b bigint, deckung double")
    assert {r.k: r.kopf for r in M.stars(rows, pairs, "k", "p", 1000).collect()} == head


@pytest.mark.parametrize("few", [0, 100_000])
def test_stars_decide_long_chains(spark, monkeypatch, few):
    """In rounds and on the driver: a clique of 60 rows, whose chain of fresher neighbours is as long, and a path of 20."""
    monkeypatch.setattr(M, "FEW", few, raising=False)
    edges = [(a, b, 1.0) for a in range(60) for b in range(a + 1, 60)] + [(a, a + 1, 1.0) for a in range(100, 119)]
    ks = [*range(60), *range(100, 120)]
    rows = spark.createDataFrame([(k,) for k in ks], "k bigint").select("k", F.timestamp_seconds(F.col("k")).alias("p"))
    pairs = spark.createDataFrame(edges, "a bigint, b bigint, deckung double")
    got = {r.k: r.kopf for r in M.stars(rows, pairs, "k", "p", 1000).collect()}
    want = {k: 59 for k in range(60)} | {k: k if k % 2 else k + 1 for k in range(100, 120)}
    assert got == want


def test_regression_and_phases(spark):
    rows = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 3.0, 7.0), ("a", float("inf"), 1.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "g string, x double, y double")
    got = {r.g: (r.steigung, r.achse) for r in S.regression(rows, ["g"], "x", "y").collect()}
    assert got == {"a": (2.0, 1.0), "c": (None, None)}
    kind = "array<struct<von_monat:int,bis_monat:int,betrag:double>>"
    df = spark.createDataFrame([([(1, 6, 10.0), (7, None, 20.0)],), ([(1, 12, 5.0)],), ([],), (None,)], f"p {kind}")
    assert [r.x for r in df.select(S.phase_total(F.col("p")).alias("x")).collect()] == [420.0, 120.0, None, None]


def test_streaks_hysteresis_ageing(spark):
    rows = spark.createDataFrame([(1, i, b, v) for i, (b, v) in enumerate([(True, 70.0), (True, 65.0), (False, 59.0), (True, 65.0)])], "k int, n int, bad boolean, v double")
    assert [r.fehlserie for r in ST.failure_streaks(rows, "k", ["n"], F.col("bad")).orderBy("n").collect()] == [1, 2, 0, 1]
    assert [r.drin for r in ST.hysteresis(rows, "k", ["n"], "v", 68, 60).orderBy("n").collect()] == [True, True, False, False]
    assert ST.ageing(rows, "k", "n", 4).collect()[0].stufe == 1


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k bigint, n bigint, v double, w string")
    assert R.latest(e, ["k"], ["n"]).count() == 0
    assert R.unseen(e, e, "k", ["n"]).count() == 0
    assert ST.change_points(e, ["k"], ["n"], "v").count() == 0
