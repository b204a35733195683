"""Fetching as a table function: the client is given, the policy is here.

One task owns a host, so the pause between its requests needs no lock across
the cluster; a source has a deadline that all its attempts share.  The client
``get(url, headers, timeout) -> (status, body)`` may raise OSError.

Defined results: null and empty addresses give status 0 and "keine Adresse";
a deadline that is spent gives "frist"; the last status and the number of
attempts are always reported, one row in gives one row out.
"""

from __future__ import annotations

import html
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellwerk.functions import urls as U
from quellwerk.session import new_folder

Get = Callable[[str, dict, float], tuple[int, str]]
#: Other names a client goes by when it is refused; statuses that refuse a name; statuses that pass; pauses before a new attempt.
AGENTS = ("quellwerk/1.0", "Mozilla/5.0 (compatible; quellwerk)")
REFUSED, PASSING, PAUSES = (403, 406), (429, 500, 502, 503), (4.0, 9.0)


def attempt(url: str | None, get: Get, deadline: float, timeout: float, quick: bool, sleep: Callable[[float], None], clock: Callable[[], float]) -> tuple[int, str | None, int, str | None]:
    """(status, body, attempts, reason): names are swapped once, passing faults are waited for, quick mode does neither."""
    if not url:
        return 0, None, 0, "keine Adresse"
    began, tries, agent, waits = clock(), 0, 0, list(PAUSES)
    while True:
        left = deadline - (clock() - began)
        if left <= 0:
            return 0, None, tries, "frist"
        tries += 1
        try:
            status, body = get(url, {"User-Agent": AGENTS[agent]}, min(timeout, left))
        except OSError:
            status, body = 0, ""
        if 200 <= status < 300:
            return status, body, tries, None
        if quick:
            return status, None, tries, "fehler"
        if status in REFUSED and agent + 1 < len(AGENTS):
            agent += 1
        elif (status in PASSING or status == 0) and waits:
            pause = waits.pop(0)
            if pause >= deadline - (clock() - began):
                return status, None, tries, "frist"
            sleep(pause)
        else:
            return status, None, tries, "fehler"


def fetched(rows: DataFrame, url: str, get: Get, deadline: float = 75.0, timeout: float = 20.0, gap: float = 0.5, quick: bool = False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """The rows with status, inhalt, versuche, grund; a host is visited by one task, with a pause between its requests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            out = []
            for address, host in zip(batch[url].tolist(), batch["_host"].tolist()):
                if host == last and gap > 0:
                    sleep(gap)
                last = host
                out.append(attempt(address, get, deadline, timeout, quick, sleep, clock))
            yield batch.drop(columns="_host").assign(status=pd.Series([x[0] for x in out], dtype="int32", index=batch.index), inhalt=pd.Series([x[1] for x in out], dtype=object, index=batch.index), versuche=pd.Series([x[2] for x in out], dtype="int32", index=batch.index), grund=pd.Series([x[3] for x in out], dtype=object, index=batch.index))

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    hosts = rows.withColumn("_host", U.host(F.col(url)))
    return hosts.repartition("_host").sortWithinPartitions("_host").mapInPandas(run, f"{kinds}, status int, inhalt string, versuche int, grund string")


def document(content: Column, kind: Column) -> Column:
    """struct<text, hash, art>: text of fetched bytes by what they are (HTML, PDF, text) and the first 32 digits of their SHA-256; a PDF without a reader has no text."""
    from quellwerk.functions.text import visible

    text = F.try_validate_utf8(content.cast("string"))
    what = F.when(F.substring(content, 1, 5) == F.lit(bytearray(b"%PDF-")), "pdf").when(F.lower(kind).contains("html") | F.lower(F.substring(text, 1, 200)).rlike(r"<(?:!doctype|html|body|p|div)\b"), "html").otherwise("text")
    plain = F.when(what == "html", visible(text)).when(what == "text", F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(content.isNotNull(), F.struct(plain.alias("text"), F.substring(F.sha2(content, 256), 1, 32).alias("hash"), what.alias("art")))


def searched(questions: DataFrame, question: str, search: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """The rows once per hit with titel and url; a question the search fails on has none and takes no other with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                try:
                    hits = search(record[question]) if record[question] else []
                except Exception:  # noqa: BLE001
                    hits = []
                rows += [{**record, "titel": t, "url": u} for t, u in hits]
            yield pd.DataFrame(rows, columns=[*batch.columns, "titel", "url"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in questions.dtypes)
    return questions.mapInPandas(run, f"{kinds}, titel string, url string")


def sent(rows: DataFrame, key: str, send: Callable[[dict], int] | None) -> DataFrame:
    """key and stand: gesendet (2xx), abgewiesen (other 4xx, never again), offen (429, 5xx, no answer: may be tried again); without a client it is a dry run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            states = []
            for record in batch.to_dict("records"):
                if send is None:
                    states.append("probe")
                    continue
                try:
                    status = send(record)
                except OSError:
                    status = 0
                states.append("gesendet" if 200 <= status < 300 else "abgewiesen" if 400 <= status < 500 and status != 429 else "offen")
            yield pd.DataFrame({key: batch[key], "stand": pd.Series(states, dtype=object, index=batch.index)})

    return rows.mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, stand string")


def published(rows: DataFrame, index: Column, words: Column, key: str) -> dict[str, str]:
    """Folders of a search index (one JSON line a row) and of a keyword index (word and number of rows), from one written projection."""
    spark = rows.sparkSession
    base, entries, keywords = (new_folder(spark, n) for n in ("projection", "suchindex", "stichworte"))
    rows.select(F.col(key), index.alias("eintrag"), words.alias("woerter")).write.parquet(base)
    once = spark.read.parquet(base)
    once.select("eintrag.*").write.option("ignoreNullFields", "false").json(entries)
    once.select(F.explode(F.array_distinct("woerter")).alias("wort")).groupBy("wort").agg(F.count("*").alias("n")).write.json(keywords)
    return {"suchindex": entries, "stichworte": keywords}


_LINK = re.compile(r"\[([^\]\n]+)\]\(([^)\s]+)\)")
_INLINE = ((re.compile(r"\*\*([^*\n]+)\*\*"), r"<strong>\1</strong>"), (re.compile(r"(?<!\*)\*([^*\n]+)\*(?!\*)"), r"<em>\1</em>"))


def safe_html(markdown: str | None) -> str:
    """Paragraphs, second and third headings, lists, emphasis and http links of a Markdown text; everything else is shown as it is written."""
    out, items = [], []

    def inline(text: str) -> str:
        text = html.escape(text, quote=True)
        text = _LINK.sub(lambda m: f'<a href="{m.group(2)}">{m.group(1)}</a>' if re.match(r"https?://", m.group(2)) else m.group(0), text)
        for pattern, to in _INLINE:
            text = pattern.sub(to, text)
        return text

    def close():
        if items:
            out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            items.clear()

    for block in re.split(r"\n\s*\n", (markdown or "").strip()):
        for line in block.split("\n") if block.startswith(("- ", "#")) else [" ".join(block.split())]:
            if line.startswith("- "):
                items.append(inline(line[2:].strip()))
                continue
            close()
            level = 3 if line.startswith("### ") else 2 if line.startswith("## ") else 0
            if level:
                out.append(f"<h{level}>{inline(line[level + 1 :].strip())}</h{level}>")
            elif line.strip():
                out.append(f"<p>{inline(line.strip())}</p>")
        close()
    return "".join(out)


def script_safe(json_text: Column) -> Column:
    """JSON that may stand inside a script element."""
    out = json_text
    for a, b in (("<", r"\u003c"), (">", r"\u003e"), ("&", r"\u0026"), ("\u2028", r"\u2028"), ("\u2029", r"\u2029")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
