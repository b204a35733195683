"""Choosing and placing records: leads and companions, pages, series, tails, plans.

Every choice is a top-k per group that Spark cuts in each partition before the
shuffle, so no group is gathered; orders are total, so ties are defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.operators.relational import top_per_group


def lead_and_companions(rows: DataFrame, group: list[str], order: list[Column], width: str, least: int = 500, first: int = 5, companions: int = 3) -> DataFrame:
    """The rows with ``rolle`` and ``platz``: the lead is the first of the top few with a wide image, else the first; companions have an image first."""
    wide = (F.coalesce(F.col(width), F.lit(0)) >= least).cast("int")
    top = top_per_group(rows, group, order, first, "_o")
    lead = top_per_group(top, group, [wide.desc(), F.col("_o")], 1, "_l").drop("_l")
    # one more than needed, the lead may be among them
    pictured = top_per_group(rows.withColumn("_w", wide), group, [F.col("_w").desc(), *order], companions + 1, "_c").drop("_w")
    keys = rows.columns
    rest = pictured.join(lead.select(*keys), on=[pictured[c].eqNullSafe(lead[c]) for c in keys], how="left_anti")
    w = Window.partitionBy(*group).orderBy("_c")
    rest = rest.withColumn("platz", F.row_number().over(w)).where(F.col("platz") <= companions)
    return lead.select(*keys, F.lit("lead").alias("rolle"), F.lit(0).alias("platz")).union(rest.select(*keys, F.lit("begleiter").alias("rolle"), "platz"))


def front_page(rows: DataFrame, page: list[str], sender: str, order: list[Column], width: str, slots: tuple[int, ...] = (1, 2, 4, 7), least: int = 600, per_sender: int = 2) -> DataFrame:
    """The rows placed on a page with ``stufe`` (0: lead) and ``platz``: at most two per sender, the lead needs a wide image if any has one."""
    total = sum(slots)
    few = top_per_group(rows, [*page, sender], order, per_sender, "_s")
    top = top_per_group(few, page, order, total, "_o")
    wide = (F.coalesce(F.col(width), F.lit(0)) >= least).cast("int")
    w = Window.partitionBy(*page)
    lead = F.first("_o").over(w.orderBy(wide.desc(), "_o"))
    placed = top.withColumn("_l", (F.col("_o") == lead).cast("int"))
    placed = placed.withColumn("platz", F.row_number().over(w.orderBy(F.col("_l").desc(), "_o")))
    ends = [sum(slots[: i + 1]) for i in range(len(slots))]
    stage = F.lit(len(slots) - 1)
    for i in reversed(range(len(ends) - 1)):
        stage = F.when(F.col("platz") <= ends[i], i).otherwise(stage)
    return placed.withColumn("stufe", stage).drop("_s", "_o", "_l")


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows with the same key the smallest in the order; a hash aggregation, rows without key all stay."""
    cols = rows.columns
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *[c for c in cols if c not in order])).alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in cols]).union(rows.where(F.col(key).isNull()).select(*cols))


def series(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows with ``nr`` in their series and ``letzter``."""
    w = Window.partitionBy(key)
    return rows.withColumn("nr", F.row_number().over(w.orderBy(*order))).withColumn("letzter", F.col("nr") == F.count("*").over(w))


def preference(text: Column, wanted: tuple[str, ...]) -> Column:
    """Index of the first wanted word a text holds; the number of words if it holds none."""
    out = F.lit(len(wanted))
    for i in reversed(range(len(wanted))):
        out = F.when(F.contains(text, F.lit(wanted[i])), i).otherwise(out)
    return out


def tail(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of the order with ``platz``; a top-k, no global sort."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("platz", F.row_number().over(Window.orderBy(*order)))  # n rows


def latest_text(rows: DataFrame, key: Column, version: list[str], text: Column) -> DataFrame:
    """schluessel, text, hash, offen: the latest version of each text, its hash and the number of its open fields."""
    newest = rows.select(key.alias("schluessel"), F.struct(*version).alias("v"), text.alias("t")).where("schluessel is not null").groupBy("schluessel").agg(F.max_by("t", "v").alias("text"))
    return newest.select("schluessel", "text", F.substring(F.sha2("text", 256), 1, 12).alias("hash"), F.size(F.regexp_extract_all("text", F.lit(r"(\{\{[^{}]*\}\})"), 1)).alias("offen"))
