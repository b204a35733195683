"""Events, selections, ledgers and similarity against plain Python, with nulls, ties and empty tables."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from quellwerk.operators import events as V
from quellwerk.operators import ledger as L
from quellwerk.operators import relational as R
from quellwerk.operators import selection as X
from quellwerk.operators import similarity as M

T = dt.datetime


def test_pairs_meet_by_actor_and_time(spark):
    t0 = T(2026, 1, 1)
    rows = [("a", "Nova baut 50 Masten", None, t0), ("b", "Nova baut 50 Masten jetzt", None, t0 + dt.timedelta(hours=71)), ("c", "Nova baut 50 Masten", None, t0 + dt.timedelta(hours=200)), ("d", None, None, t0), ("e", "Nova baut 50 Masten", None, None)]
    d = V.described(spark.createDataFrame(rows, "id string, title string, operator string, published timestamp"), "id", "title", "operator", "published")
    got = [(r.k_a, r.k_b, r.urteil) for r in V.verdict(V.near_pairs(d, d)).collect()]
    assert got == [("b", "a", "gleich")]
    assert [tuple(r) for r in V.remembered(d, d).collect()] == [("b", "a")]
    none = d.limit(0)
    assert V.near_pairs(none, none).count() == 0


def test_names_in_texts(spark):
    rows = spark.createDataFrame([(1, "Bei Nova Net Plus und Nova"), (2, None), (3, "nichts")], "k int, t string")
    names = spark.createDataFrame([("Nova Net",), ("Nova",), (None,), ("",)], "name string")
    found = V.mentions(rows, F.col("k"), F.col("t"), names, "name")
    assert {(r.name, r.start) for r in found.collect()} == {("Nova Net", 2), ("Nova", 2), ("Nova", 6)}
    assert [tuple(r) for r in V.recognised(found, ("plus",)).collect()] == [(1, "Nova")]


def test_front_page_and_leads(spark):
    rows = [(n, "s" + str(n % 3), 700 if n == 4 else 0) for n in range(12)]
    df = spark.createDataFrame(rows, "id int, s string, w int").withColumn("p", F.lit("x"))
    page = {r.id: r.platz for r in X.front_page(df, ["p"], "s", [F.col("id")], "w", slots=(1, 2)).collect()}
    assert page == {0: 1, 1: 2, 2: 3}
    lead = [(r.id, r.rolle, r.platz) for r in X.lead_and_companions(df, ["p"], [F.col("id")], "w").orderBy("platz").collect()]
    assert lead == [(4, "lead", 0), (0, "begleiter", 1), (1, "begleiter", 2), (2, "begleiter", 3)]
    assert X.front_page(df.limit(0), ["p"], "s", [F.col("id")], "w").count() == 0


def test_states_and_merges(spark):
    ev = spark.createDataFrame([(1, 1, "auf"), (1, 2, "tot"), (1, 3, "auf"), (2, 1, "auf"), (2, 2, "egal")], "k int, n int, art string")
    got = {(r.k, r.stand, r.seit) for r in L.fold_states(ev, "k", ["n"], {"auf": "an", "tot": "aus"}, ("aus",)).collect()}
    assert got == {(1, "aus", 2), (2, "an", 1)}
    store = L.Merged(spark)
    one = spark.createDataFrame([(1, 1, "x"), (2, 1, None)], "k int, n int, v string")
    store.write(one, ["k"], ["n"])
    store.write(one, ["k"], ["n"])
    out = store.write(spark.createDataFrame([(1, 2, "y")], "k int, n int, v string"), ["k"], ["n"])
    assert {tuple(r) for r in out.collect()} == {(1, 2, "y"), (2, 1, None)}
    state = spark.createDataFrame([("a", "1"), ("alt", "2")], "k string, v string")
    now = spark.createDataFrame([("a", "1", None), ("b", "2", "alt"), ("c", "3", None)], "k string, v string, frueher string")
    assert {tuple(r) for r in L.changed(state, now, "k", "v", "frueher").collect()} == {("a", "gleich"), ("b", "gleich"), ("c", "neu")}


def test_value_diff_gathers_changes_only(spark):
    old = spark.createDataFrame([("k", x) for x in (1, 2, 3, None)] + [("same", 1)], "k string, v int")
    new = spark.createDataFrame([("k", x) for x in (2, 3, 4, 4)] + [("same", 1), ("neu", 9)], "k string, v int")
    assert {(r.k, tuple(r.dazu), tuple(r.weg)) for r in R.value_diff(old, new, ["k"], "v").collect()} == {("k", (4,), (1,)), ("neu", (9,), ())}


def test_upsert_meets_by_words(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    pick = lambda: sorted({rng.choice(words) for _ in range(rng.randrange(1, 5))})
    new, known = [(i, "b", pick()) for i in range(60)], [(i, "b", pick()) for i in range(40)]
    want = {}
    for i, _, a in new:
        best = min(((-len(set(a) & set(b)) / min(len(a), len(b)), k) for k, _, b in known if len(set(a) & set(b)) / min(len(a), len(b)) >= 0.6), default=None)
        want[i] = best[1] if best else None
    n = spark.createDataFrame(new, "p int, b string, w array<string>")
    k = spark.createDataFrame(known, "k int, b string, v array<string>")
    assert {r.p: r.k for r in M.fuzzy_upsert(n, k, "b", "p", "w", "k", "v", 0.6).collect()} == want


def test_all_overlap_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, T(2026, 1, 1) + dt.timedelta(hours=rng.randrange(300))]), sorted({rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))})) for i in range(60)]
    near = lambda a, b: a is None or b is None or abs((a - b).total_seconds()) <= 72 * 3600
    want = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if near(x[1], y[1]) and len(set(x[2]) & set(y[2])) / min(len(x[2]), len(y[2])) >= 0.5}
    df = spark.createDataFrame(rows, "id int, p timestamp, ws array<string>")
    assert {(r.a, r.b) for r in M.all_overlap_pairs(df, "id", F.col("ws"), "p", 72, 0.5).collect()} == want


def test_attached_is_what_is_remembered_without_all_pairs(spark, tmp_path, monkeypatch):
    """Random records with few words, numbers, ties of time and missing values, against the pairs; the query forms none."""
    rng = random.Random(7)
    pick = lambda pool, most: sorted(rng.sample(pool, rng.randrange(0, most)))
    rows = [(f"k{i}", rng.choice([None, "x", "y"]), T(2026, 1, 1) + dt.timedelta(hours=rng.randrange(900)), pick([f"w{j}" for j in range(14)], 7), pick(["p", "q", "r", "s"], 3), pick(["1", "2.5", "7", "8"], 2)) for i in range(260)]
    d = spark.createDataFrame(rows, "k string, betreiber string, zeit timestamp_ntz, woerter array<string>, akteure array<string>, zahlen array<string>")
    want = {r.k for r in V.remembered(d, d).collect()}
    for last in (1, 6):
        assert {r.k for r in V.attached(d, last=last).collect()} == want and 20 < len(want) < 240
    from quellwerk.plans import registry

    def pairs(*_):
        raise AssertionError("all pairs are formed")

    monkeypatch.setattr(V, "near_pairs", pairs)
    items = [(f"i{j}", f"u{j}", f"Vosuru Net raises prices by {j % 3} percent", "Vosuru Net", T(2026, 1, 1 + 9 * (j % 2)), T(2026, 1, 20)) for j in range(4)]
    spark.createDataFrame(items, "id string, url string, title string, operator string, published timestamp_ntz, eingang_am timestamp_ntz").write.parquet(f"{tmp_path}/items.parquet")
    got = registry()[0]["i4_follow_ups"](spark, str(tmp_path))
    assert sorted((str(r.tag), r.meldungen, r.folgen) for r in got.collect()) == [("2026-01-01", 2, 2), ("2026-01-10", 2, 2)]


def test_follow_ups_send_no_keys_to_the_driver(spark, tmp_path, monkeypatch):
    """Whatever the files of the keys weigh, no join of the query broadcasts them."""
    from quellwerk.plans import events, registry

    items = [(f"i{j}", f"u{j}", f"Vosuru Net raises prices by {j} percent", "Vosuru Net", T(2026, 1, 1 + 9 * (j % 2)), T(2026, 1, 20)) for j in range(4)]
    spark.createDataFrame(items, "id string, url string, title string, operator string, published timestamp_ntz, eingang_am timestamp_ntz").write.parquet(f"{tmp_path}/items.parquet")
    plans, write = [], V.materialise
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def seen(df, label):
        plans.append(plan(df))
        return write(df, label)

    for module in (V, events):
        monkeypatch.setattr(module, "materialise", seen)
    plans.append(plan(registry()[0]["i4_follow_ups"](spark, str(tmp_path))))
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    assert len(joins) >= 8 and not [j for j in joins if "Broadcast" in j]


def test_judged_is_the_verdict_of_all_near_pairs_by_bits(spark, tmp_path, monkeypatch):
    """Random records with more words and actors than bits, sets above the table of quotients, ties of time and missing values, against the pairs; the query compares bits."""
    rng = random.Random(8)
    pick = lambda pool, most: sorted(rng.sample(pool, rng.randrange(0, most)))
    words, names = [f"w{j}" for j in range(150)], ["p", "q", "r", *(f"a{j}" for j in range(120))]
    near = lambda: rng.choice([None, pick(words[:12], 8), pick(words, 9), pick(words[:40], 40), pick(words[60:], 70)])
    rows = [(f"k{i}", rng.choice([None, "x", "y"]), T(1969, 12, 20) + dt.timedelta(hours=rng.randrange(500), microseconds=rng.choice([0, 0, 1])), near(), rng.choice([None, pick(names[:6], 4), pick(names, 6), pick(names, 40)]), rng.choice([None, pick(["1", "2.5", "7", *map(str, range(100, 190))], 6)])) for i in range(320)]
    d = spark.createDataFrame(rows, "k string, betreiber string, zeit timestamp_ntz, woerter array<string>, akteure array<string>, zahlen array<string>")
    of = lambda df: sorted(map(tuple, df.select("k_a", "k_b", "aehnlich", F.col("gemeinsame_zahl").cast("string"), "urteil").collect()), key=str)
    want = of(V.verdict(V.near_pairs(d, d)))
    assert len(want) > 1000 and {r[4] for r in want} == {"gleich", "grau", "verschieden"} and {r[3] for r in want} == {None, "true", "false"}
    for longs in (1, 3):
        assert of(V.judged(d, longs=longs)) == want
    assert V.judged(d.limit(0)).count() == 0
    from quellwerk.plans import registry

    def sets(*_):
        raise AssertionError("the sets of every pair are compared")

    monkeypatch.setattr(V, "near_pairs", sets)
    items = [(f"i{j}", f"u{j}", f"Vosuru Net raises prices by {j % 3} percent", "Vosuru Net", T(2026, 1, 1 + 9 * (j % 2)), T(2026, 1, 20)) for j in range(4)]
    spark.createDataFrame(items, "id string, url string, title string, operator string, published timestamp_ntz, eingang_am timestamp_ntz").write.parquet(f"{tmp_path}/items.parquet")
    got = registry()[0]["c7_pair_verdict"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(f"i{a}", f"i{b}", 1.0, False, "gleich") for a, b in ((0, 2), (1, 3), (2, 0), (3, 1))]
