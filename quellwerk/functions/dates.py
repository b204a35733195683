"""Days written in many ways: Column -> Column, all inside code generation.

Every function gives null for null, empty and undated texts and for days that
are not in the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, January to December, in the languages that dates are read in.
MONTH_NAMES = """
january february march april may june july august september october november december
januar februar märz april mai juni juli august september oktober november dezember
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık
januari februari maret april mei juni juli agustus september oktober november desember
"""
# English short forms.
SHORT_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec"
_LINES = [line.split() for line in MONTH_NAMES.strip().splitlines()] + [SHORT_NAMES.split()]
#: name -> number of the month
MONTHS = {name: i for line in _LINES for i, name in enumerate(line, 1)}
_NAME = r"\p{L}+"


def month_number(name: Column) -> Column:
    """1 to 12 for a month's name in any of the languages; null else."""
    table = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.lower(F.replace(name, F.lit("İ"), F.lit("i"))))


def calendar_day(year: Column, month: Column, day: Column) -> Column:
    """The day, if the calendar has it; parts may be text or numbers."""
    parts = [x.cast("string") for x in (year, month, day)]
    whole = F.concat_ws("-", *parts)
    return F.when(whole.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(whole, F.lit("yyyy-M-d"))).cast("date")


def _parts(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(text, pattern, i) for i in (1, 2, 3))


def numeric_day(text: Column) -> Column:
    """The first yyyy-mm-dd, yyyymmdd (if it is the whole text), d.m.yyyy or d/m/yyyy."""
    y, m, d = _parts(text, r"(?:^|\D)(\d{4})-(\d{1,2})-(\d{1,2})(?:\D|$)")
    y2, m2, d2 = _parts(text, r"^\s*(\d{4})(\d{2})(\d{2})\s*$")
    d3, m3, y3 = _parts(text, r"(?:^|\D)(\d{1,2})[./](\d{1,2})[./](\d{4})(?:\D|$)")
    return F.coalesce(calendar_day(y, m, d), calendar_day(y2, m2, d2), calendar_day(y3, m3, d3))


def named_day(text: Column) -> Column:
    """The first day with a month's name: day, month, year (with ordinals and "de") or month, day, year."""
    d, m, y = _parts(text, rf"(?:^|\D)(\d{{1,2}})(?:st|nd|rd|th|er|º|\.)?\s+(?:de\s+)?({_NAME})\.?,?\s+(?:de\s+)?(\d{{4}})(?:\D|$)")
    m2, d2, y2 = _parts(text, rf"(?:^|\P{{L}})({_NAME})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:\D|$)")
    return F.coalesce(calendar_day(y, month_number(m), d), calendar_day(y2, month_number(m2), d2))


def epoch_day(text: Column) -> Column:
    """The day of a text of ten (seconds) or thirteen digits (milliseconds)."""
    n = F.when(F.trim(text).rlike(r"^\d{10}$|^\d{13}$"), F.trim(text).try_cast("bigint"))
    return F.to_date(F.timestamp_millis(F.when(F.length(F.trim(text)) == 10, n * 1000).otherwise(n)))


def any_day(text: Column) -> Column:
    """A day in any of the forms above, numbers before names before epochs."""
    return F.coalesce(numeric_day(text), named_day(text), epoch_day(text))


def split_day(year: Column, month: Column, day: Column) -> Column:
    """A day from separate fields; the month may be a name, a missing day is the first."""
    return calendar_day(year, F.coalesce(month_number(month.cast("string")).cast("string"), month.cast("string")), F.coalesce(day, F.lit(1)))


def path_day(url: Column) -> Column:
    """struct<tag, genau>: the day in an address path; without a day of the month it is the first and not exact."""
    y, m, d = _parts(url, r"/(20\d\d)/(0?[1-9]|1[0-2])(?:/(0?[1-9]|[12]\d|3[01]))?(?:/|$)")
    day = calendar_day(y, m, F.when(d == "", F.lit("1")).otherwise(d))
    return F.when(day.isNotNull(), F.struct(day.alias("tag"), (d != "").alias("genau")))


def cascade(fields: list[Column], url: Column, today: Column) -> Column:
    """struct<tag, genau>: the first field that holds a day, else the address; days after tomorrow are no dates of publication."""
    usable = lambda c: F.when(c <= F.date_add(today, 1), c)
    of_fields = F.coalesce(*[usable(any_day(c)) for c in fields])
    of_path = path_day(url)
    return F.when(of_fields.isNotNull(), F.struct(of_fields.alias("tag"), F.lit(True).alias("genau"))).when(usable(of_path["tag"]).isNotNull(), of_path)
