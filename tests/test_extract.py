from pyspark.sql import functions as F

from quellwerk.functions import extract as X
from quellwerk.operators import models


def _all(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column(F.col("v")).alias("x"))
    return [r.x for r in df.orderBy("i").collect()]


def test_delivery(spark):
    got = _all(spark, X.delivery_days, ["Lieferzeit 1-2 Wochen", "in 3 Werktagen", "Sofort verfügbar", "nicht lieferbar", "rot", None])
    assert [tuple(x) if x else None for x in got] == [("wartezeit", 7, 14), ("sofort", 3, 3), ("sofort", None, None), ("nicht", None, None), None, None]


def test_days_storage_sections(spark):
    assert [str(x) for x in _all(spark, X.first_day, ["am 3.7.2026 und", "2026-07-04", "31.2.2026", None])] == ["2026-07-03", "2026-07-04", "None", "None"]
    assert _all(spark, X.storage_gb, ["X 8 GB RAM 256GB", "1 TB", "64 GB / 128 GB", "ohne"]) == [256, 1024, None, None]
    assert _all(spark, X.sections, ["## A\nx\n## B\ny\n## A\nz", "ohne", ""]) == [{"A": "z", "B": "y"}, {}, {}]


def test_model_failures_stay_with_their_row(spark):
    rows = spark.createDataFrame([(i, "gut" if i != 7 else "böse") for i in range(20)], "i int, t string")

    def model(texts):
        if "böse" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    got = {r.i: (r.a, r.s) for r in models.apply(rows.coalesce(1), "t", model, "a", "s").collect()}
    assert got[7] == (None, "fehler") and all(got[i] == ("GUT", "ok") for i in range(20) if i != 7)


def test_delivery_days_reads_a_text_once(spark):
    df = spark.createDataFrame([("Versand 4 bis 6 Wochen, in Tagen",), ("Lieferung in 1234 Tagen; Tag 3. Binnen 2–3 Werktagen",), ("Laufzeit 5 Tage, Lieferung in 2 Tagen",)], "t string").repartition(1)
    x = df.select(X.delivery_days(F.col("t")).alias("x")).select("x.lage", "x.von", "x.bis")
    # the text is cut into tokens in one place of the plan, not once for every use of a token
    assert x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {tuple(r) for r in x.collect()} == {("wartezeit", 28, 42), ("sofort", 2, 3), (None, None, None)}
