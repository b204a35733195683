"""Sentence boundaries of every document (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quellwerk.llm.sentence_rules import sentence_spans


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, anfang, ende: one row per sentence, as code-point offsets.

    One pass, no shuffle.  Null, empty and blank texts have no rows; texts of
    any length are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, t in zip(batch["k"].tolist(), batch["t"].tolist()):
                for a, b in sentence_spans(t):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({key: pd.Series(keys, dtype="int64"), "anfang": pd.Series(starts, dtype="int32"), "ende": pd.Series(ends, dtype="int32")})

    source = docs.where(f"`{key}` is not null").selectExpr(f"cast(`{key}` as bigint) as k", f"`{text}` as t")
    return source.mapInPandas(run, f"{key} bigint, anfang int, ende int")
