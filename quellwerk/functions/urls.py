"""Address functions: Column -> Column, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track where a click came from.
TRACKING = r"(?i)^(utm_[^=]*|fbclid|gclid|mc_[^=]*|ref|source)(=|$)"


def _parts(url: Column):
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    return host, F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)


def normalize(url: Column) -> Column:
    """https, lower host without www., path without trailing slash, query without tracking in its order, no fragment; null stays null."""
    host, path, query = _parts(url)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.concat(F.lit("https://"), host, F.regexp_replace(path, r"/+$", ""), tail)


def sorted_lower(url: Column) -> Column:
    """All lower case, parameters sorted, scheme kept away: the form for comparing saved links."""
    host, path, query = _parts(F.lower(url))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def host_path(url: Column) -> Column:
    """Host and path alone."""
    host, path, _ = _parts(url)
    return F.concat(host, F.regexp_replace(path, r"/+$", ""))


def host(url: Column) -> Column:
    return _parts(url)[0]


def registrable(url: Column) -> Column:
    """Last two labels of the host."""
    return F.substring_index(host(url), ".", -2)


def path_date(url: Column) -> Column:
    """A date from /YYYY/MM/DD/ or, as the month's first day, /YYYY/MM/ in the path; null if there is none or it is impossible."""
    y, m, d = (F.regexp_extract(url, r"/(20\d\d)/(0[1-9]|1[0-2])(?:/(0[1-9]|[12]\d|3[01]))?(?:/|$)", i) for i in (1, 2, 3))
    return F.try_to_timestamp(F.when(y != "", F.concat_ws("-", y, m, F.when(d == "", F.lit("01")).otherwise(d))), F.lit("yyyy-MM-dd")).cast("date")


def item_id(url: Column) -> Column:
    """First sixteen hex digits of the SHA-256 of the normal form."""
    return F.substring(F.sha2(normalize(url), 256), 1, 16)
