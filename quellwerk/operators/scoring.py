"""Scores: BM25, document frequency weights, regression, effective prices, composite axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """key, wort, tf, dl (words of the document)."""
    w = docs.select(key, words.alias("_w")).withColumn("dl", F.size("_w"))
    return w.select(key, "dl", F.explode("_w").alias("wort")).groupBy(key, "dl", "wort").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, words: Column, queries: DataFrame, least: float, k: int) -> DataFrame:
    """anfrage, key, punkte, rang: the k best documents of each query (anfrage, wort).

    The query side is joined to the postings by word, so only postings of query words are scored.
    """
    from quellwerk.operators.relational import top_per_group

    p = postings(docs, key, words)
    wanted = queries.select("anfrage", "wort").distinct()
    hit = p.join(wanted, "wort")
    n, avgdl = docs.select(F.size(words).alias("dl")).agg(F.count("*"), F.avg("dl")).first()  # one row
    df = p.join(wanted.select("wort").distinct(), "wort", "left_semi").groupBy("wort").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    scored = hit.join(df, "wort").groupBy("anfrage", key).agg(F.round(F.sum(part), 6).alias("punkte"))
    return top_per_group(scored.where(F.col("punkte") >= least), ["anfrage"], [F.col("punkte").desc(), key], k)


def regression(rows: DataFrame, group: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Slope and intercept of y over x per group from at least so many finite points, 4 digits; null when x does not vary."""
    finite = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")) & ~F.isnan(x) & ~F.isnan(y))
    return finite.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.regr_slope(y, x), 4).alias("steigung"), F.round(F.regr_intercept(y, x), 4).alias("achse")).where(F.col("n") >= least)


def phase_total(phases: Column, horizon: int = 24) -> Column:
    """Sum of months x amount over price phases, clipped to the horizon; an open last phase runs to its end, the tail keeps the last price."""
    end = lambda p: F.least(F.coalesce(p["bis_monat"], F.lit(horizon)), F.lit(horizon))
    months = lambda p: F.greatest(end(p) - p["von_monat"] + 1, F.lit(0))
    total = F.aggregate(phases, F.lit(0.0), lambda s, p: s + months(p) * F.coalesce(p["betrag"], F.lit(0.0)))
    covered = F.aggregate(phases, F.lit(0), lambda s, p: F.greatest(s, end(p)))
    last = F.try_element_at(phases, F.lit(-1))["betrag"]
    return F.when(F.size(phases) > 0, total + F.greatest(F.lit(horizon) - covered, F.lit(0)) * F.coalesce(last, F.lit(0.0)))


def composite(axes: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted axes of 0-3 as 0-100, a missing axis counts 0, half to even."""
    total = sum(weights.values())
    return F.bround(sum((F.coalesce(axes[a], F.lit(0)) * (w / total / 3.0 * 100.0) for a, w in weights.items()), F.lit(0.0)), 0).cast("int")


def urgency(days: Column) -> Column:
    """0-3 by the days to an end: 3 up to 14, 2 up to 30, 1 up to 90, 0 beyond, past or unknown."""
    return F.when(days < 0, 0).when(days <= 14, 3).when(days <= 30, 2).when(days <= 90, 1).otherwise(0)


def momentum(others: Column) -> Column:
    """0-3 by the number of others that do the same: 0, 1, 2 to 3, 4 and more."""
    return F.when(others >= 4, 3).when(others >= 2, 2).when(others >= 1, 1).otherwise(0)


def clamped(axis: Column) -> Column:
    """An axis as a whole number of 0-3; null counts 0."""
    return F.least(F.greatest(F.coalesce(axis.cast("int"), F.lit(0)), F.lit(0)), F.lit(3))


def relevance_level(home: Column, topic: Column, model: Column, fallback: Column) -> Column:
    """3 if the home market and the topic are met, else the model's value up to 2, else the fallback up to 2."""
    return F.when(home & topic, 3).otherwise(F.least(F.greatest(F.coalesce(model, fallback), F.lit(0)), F.lit(2))).cast("int")
