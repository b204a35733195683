"""External models as batch functions with a failure policy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def apply(rows: DataFrame, column: str, model: Callable[[list[str]], list[str]], answer: str, status: str, batch: int = 15) -> DataFrame:
    """Adds the model's answer and 'ok' or 'fehler'; a failed batch is asked again row by row, so one row never takes others with it."""

    def ask(texts: list[str]) -> list[tuple[str | None, str]]:
        try:
            return [(a, "ok") for a in model(texts)]
        except Exception:  # noqa: BLE001
            return [("", "")] * 0 if not texts else [(None, "fehler")] if len(texts) == 1 else [x for t in texts for x in ask([t])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [x for i in range(0, len(f), batch) for x in ask(f[column].iloc[i : i + batch].tolist())]
            yield f.assign(**{answer: pd.Series([a for a, _ in out], dtype=object, index=f.index), status: pd.Series([s for _, s in out], dtype=object, index=f.index)})

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, `{answer}` string, `{status}` string")
