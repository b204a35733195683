"""The stateful operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quellwerk.session import new_folder


def novel(stream: DataFrame, key: str, when: str, lateness: str) -> DataFrame:
    """First row of every key within the watermark; later copies are dropped with bounded state."""
    return stream.withWatermark(when, lateness).dropDuplicatesWithinWatermark([key])


def streaks(stream: DataFrame, key: str, failed: str, most: int) -> DataFrame:
    """key, fehlserie, quarantaene after every micro-batch that holds the key; rows of a batch count in the order of ``n``."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("n")
        for bad in rows[failed].tolist():
            run = run + 1 if bad else 0
        state.update((run,))
        yield pd.DataFrame({key: [k[0]], "fehlserie": [run], "quarantaene": [run >= most]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} bigint, fehlserie int, quarantaene boolean", "run int", "update", GroupStateTimeout.NoTimeout)


def changes(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, alt, neu for every change of a measured value; the last value per key is the state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for n, v in pd.concat(list(frames)).sort_values("n")[["n", value]].itertuples(index=False):
            if v is not None and v == v and v != last:
                out.append((k[0], n, last, v))
                last = v
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "n", "alt", "neu"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} bigint, n bigint, alt double, neu double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_to_end(result: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is and read what it wrote."""
    spark = result.sparkSession
    path, state = new_folder(spark, label), new_folder(spark, f"{label}-state")
    if mode == "append":
        result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()
    else:
        # a batch has a folder of its own, so a repeated one replaces itself
        write = lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch-{i}")
        result.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(path if mode == "append" else f"{path}/batch-*")
