import datetime as dt
import random

from pyspark.sql import functions as F

from quellwerk.operators import history as H

T = dt.datetime


def _tarife(spark, rows):
    return spark.createDataFrame(rows, "satz_nr bigint, tarif_id string, grundgebuehr double, versionsstand string, abgerufen_am string, eingang_am timestamp, name int")


def test_spellings_of_days_and_months(spark):
    days = ["2025-07-18", "2025-07-18T23:44:00Z", "18.07.2025", " 18.7.2025 ", "31.02.2025", "bald", "", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string").select("i", H.parse_day(F.col("d")).cast("string").alias("x"))
    assert [r.x for r in df.orderBy("i").collect()] == ["2025-07-18"] * 4 + [None] * 4
    months = ["06/2025", "6/2025", "06.2025", "01.06.2025", "06/25", "2025-06", "Juni 2025", "Stand Jun. 2025", "Stand: 06/2025", "k. A.", "13/2025", "", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(months)], "i int, d string").select("i", H.parse_month(F.col("d")).alias("x"))
    assert [r.x for r in df.orderBy("i").collect()] == [2025 * 12 + 5] * 9 + [None] * 4


def test_late_reading_splits_and_supersedes(spark):
    rows = [(1, "a", 10.0, "01/2025", "2025-01-01", T(2025, 1, 1, 5), 0), (2, "a", 12.0, "01/2025", "2025-01-09", T(2025, 1, 9, 5), 0), (3, "a", 11.0, "01/2025", "2025-01-05", T(2025, 1, 12, 5), 0)]
    book = H.tariff_ledger(_tarife(spark, rows))
    got = {(r.cent, str(r.gueltig_von), str(r.gueltig_bis), r.erfasst_von.day, r.erfasst_bis.day if r.erfasst_bis else None) for r in book.collect()}
    assert got == {
        (1000, "2025-01-01", "None", 1, 9),
        (1000, "2025-01-01", "2025-01-09", 9, 12),
        (1000, "2025-01-01", "2025-01-05", 12, None),
        (1200, "2025-01-09", "None", 9, None),
        (1100, "2025-01-05", "2025-01-09", 12, None),
    }
    assert H.as_of(book, "2025-01-10 00:00:00", "2025-01-06").select("cent").collect()[0].cent == 1000


def test_missing_values_keep_the_last_known(spark):
    rows = [(1, "a", 10.0, "01/2025", "2025-01-01", T(2025, 1, 1), 0), (2, "a", None, "01/25", "02.01.2025", T(2025, 1, 2), 0), (3, "a", 10.000000001, "", "2025-01-03", T(2025, 1, 3), 0), (4, "a", 11.0, None, "2025-01-04", T(2025, 1, 4), 0)]
    got = [tuple(r) for r in H.tariff_versions(_tarife(spark, rows)).orderBy("gueltig_von").collect()]
    assert got == [("a", "2025-01-01", "2025-01-04"), ("a", "2025-01-04", "")]


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, 1.0, "x", "2025-01-01", T(2025, 1, 1), 0), (2, "a", 1.0, "x", None, T(2025, 1, 1), 0), (3, "a", 1.0, "x", "2025-01-01", None, 0)]
    assert H.tariff_versions(_tarife(spark, rows)).count() == 0
    assert H.tariff_versions(_tarife(spark, []).limit(0)).count() == 0
    twice = [(1, "a", 1.0, "01/2025", "2025-01-01", T(2025, 1, 1), 0)] * 3
    assert H.tariff_ledger(_tarife(spark, twice)).count() == 1


def test_ledger_against_replay(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        day = dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(20))
        rows.append((i, rng.choice("ab"), float(rng.randrange(3)), None, day.isoformat(), T(2025, 3, 1) + dt.timedelta(minutes=rng.randrange(400)), 0))
    book = H.tariff_ledger(_tarife(spark, rows)).collect()
    for minute in (50, 200, 399):
        now = T(2025, 3, 1) + dt.timedelta(minutes=minute)
        held = {}
        for i, k, fee, _, day, at, _ in sorted(rows, key=lambda r: (r[5], r[0])):
            if at <= now:
                held.setdefault(k, {})[day] = int(fee * 100)
        want = set()
        for k, days in held.items():
            order = sorted(days)
            want |= {(k, d, n, days[d]) for d, n in zip(order, [*order[1:], "None"])}
        got = {(r.tarif_id, str(r.gueltig_von), str(r.gueltig_bis), r.cent) for r in book if r.erfasst_von <= now and (r.erfasst_bis is None or r.erfasst_bis > now)}
        assert got == want


def test_batches_applied_to_a_ledger_give_the_ledger_of_all(spark):
    import pytest

    rng = random.Random(11)
    rows = []
    for i in range(400):
        day = dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(25))
        rows.append((i, rng.choice("abc"), float(rng.randrange(3)), None, day.isoformat(), T(2025, 3, 1) + dt.timedelta(hours=rng.randrange(120)), 0))
    df = _tarife(spark, rows)
    whole = sorted(map(repr, H.tariff_ledger(df).collect()))
    assert sorted(map(repr, H.tariff_ledger_in_steps(df, ["2025-03-02", "2025-03-04"]).collect())) == whole
    names = ("tarif_id", "tag", "eingang_am", ["cent", "stand"], "satz_nr")
    book, r = H.tariff_ledger(df), H.tariff_readings(df)
    assert H.applied(book, r.limit(0), *names).count() == len(whole)
    with pytest.raises(ValueError):
        H.applied(book, r.limit(1), *names)
