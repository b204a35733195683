"""Queries of dates: every form is written from a known day and must be read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quellwerk.functions import dates as D
from quellwerk.plans.catalog import query
from quellwerk.session import table

_KEY = ["id", "url", "eingang_am"]


def _named(lang: int, form: str):
    """Text of a day with the month's name in one of the languages, in a form of {d}, {m}, {y}."""
    names = F.array(*[F.lit(x.capitalize()) for x in D._LINES[lang]])
    month = F.element_at(names, F.month("published"))
    parts = {"d": F.dayofmonth("published").cast("string"), "m": month, "y": F.year("published").cast("string")}
    pieces = [parts[p[0]] if i % 2 else F.lit(p) for i, p in enumerate(form.replace("}", "{").split("{"))]
    return F.concat(*pieces)


@query("SELECT id, url, eingang_am, CAST(published AS DATE) AS tag FROM items WHERE published IS NOT NULL")
def a16_multilingual_dates(spark, sf):
    """Days with month names of seven languages, inside a sentence, read back."""
    forms = [(0, "{m} {d}, {y}"), (0, "Press release {d}th {m} {y} on networks"), (1, "Stand: {d}. {m} {y}"), (2, "Madrid, {d} de {m} de {y}"), (3, "{d} de {m} de {y}, Lisboa"), (4, "le {d} {m} {y}"), (5, "{d} {m} {y} tarihinde"), (6, "Jakarta, {d} {m} {y}"), (7, "{m}. {d}, {y}")]
    items = table(spark, sf, "items").where("published is not null")
    which = F.pmod(F.length("title"), F.lit(len(forms)))
    text = F.lit(None).cast("string")
    for i, (lang, form) in enumerate(forms):
        text = F.when(which == i, _named(lang, form)).otherwise(text)
    return items.withColumn("t", text).select(*_KEY, D.named_day(F.col("t")).alias("tag"))


@query("SELECT id, url, eingang_am, CAST(published AS DATE) AS tag FROM items WHERE published IS NOT NULL")
def a13_date_formats(spark, sf):
    """Days in numeric forms, RFC 822, epochs and inside text, read back."""
    items = table(spark, sf, "items").where("published is not null")
    day = F.col("published")
    forms = [
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "dd/MM/yyyy HH:mm"), F.date_format(day, "yyyyMMdd"),
        F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss"), F.unix_timestamp(day).cast("string"), F.unix_millis(day.cast("timestamp")).cast("string"), F.concat(F.lit("updated on "), F.date_format(day, "yyyy-MM-dd"), F.lit(" by the desk")),
    ]
    which = F.pmod(F.length("title"), F.lit(len(forms)))
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(which == i, form).otherwise(text)
    return items.withColumn("t", text).select(*_KEY, D.any_day(F.col("t")).alias("tag"))


@query("SELECT id, url, eingang_am, CASE WHEN length(title) % 2 = 0 THEN CAST(date_trunc('month', published) AS DATE) ELSE CAST(published AS DATE) END AS tag FROM items WHERE published IS NOT NULL")
def a13_split_dates(spark, sf):
    """Days from separate fields: a month's name without a day, or three numbers."""
    items = table(spark, sf, "items").where("published is not null")
    even = F.length("title") % 2 == 0
    month = F.when(even, _named(4, "{m}")).otherwise(F.month("published").cast("string"))
    day = F.when(~even, F.dayofmonth("published"))
    return items.select(*_KEY, D.split_day(F.year("published"), month, day).alias("tag"))


@query(
    """SELECT id, url, eingang_am, CASE length(title) % 4 WHEN 0 THEN CAST(published AS DATE) WHEN 1 THEN CAST(date_trunc('month', published) AS DATE) WHEN 2 THEN NULL ELSE CAST(published AS DATE) END AS tag,
  CASE length(title) % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS genau FROM items WHERE published IS NOT NULL"""
)
def a7_date_cascade(spark, sf):
    """A text field before the address; days of the future are passed over; the address may know the month only."""
    items = table(spark, sf, "items").where("published is not null")
    n = F.length("title") % 4
    field = F.when(n == 0, F.date_format("published", "yyyy-MM-dd")).when(n == 2, F.lit("2099-01-01")).when(n == 3, F.lit("no date here"))
    address = F.when(n == 1, F.date_format("published", "'https://a.example/news/'yyyy/MM/'x'")).when(n == 3, F.date_format("published", "'https://a.example/'yyyy/MM/dd/'x'")).otherwise(F.lit("https://a.example/x"))
    d = D.cascade([field], address, F.to_date(F.lit("2027-01-01")))
    return items.select(*_KEY, d.alias("d")).select(*_KEY, "d.tag", "d.genau")


@query(
    r"""WITH d AS (SELECT zeilen_nr, trim(datum) AS t FROM uebersetzungen), p AS (SELECT zeilen_nr,
  regexp_extract(t, '(?:^|[^0-9])(\d{4}-\d{1,2}-\d{1,2})(?:[^0-9]|$)', 1) AS iso, regexp_extract(t, '(?:^|[^0-9])(\d{1,2}[./]\d{1,2}[./]\d{4})(?:[^0-9]|$)', 1) AS dmy FROM d)
SELECT zeilen_nr, coalesce(TRY_CAST(iso AS DATE), CAST(try_strptime(replace(dmy, '/', '.'), '%d.%m.%Y') AS DATE)) AS tag FROM p"""
)
def a13_stored_dates(spark, sf):
    """The date column of the stored lines, in whatever numeric form it is written."""
    return table(spark, sf, "uebersetzungen").select("zeilen_nr", D.numeric_day(F.trim("datum")).alias("tag"))
