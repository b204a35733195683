"""Page furniture (problem 2) and the article paragraphs of a page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quellwerk.llm.blocks import FURNITURE, label_blocks
from quellwerk.llm.residue_rules import NONE, kind


def furniture(pages: DataFrame, key: str = "zeilen_nr", blocks: str = "absaetze") -> DataFrame:
    """key, absatz_nr of every block that is page furniture and no residue.

    One pass, no shuffle: a page is judged by its own blocks.  Pages with null
    or empty lists have no rows; null and blank blocks are furniture.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, positions = [], []
            for k, page in zip(batch["k"].tolist(), batch["b"].tolist()):
                if page is None:
                    continue
                for i, label in enumerate(label_blocks(page)):
                    if label == FURNITURE and kind(page[i]) == NONE:
                        keys.append(k)
                        positions.append(i)
            yield pd.DataFrame({key: pd.Series(keys, dtype="int64"), "absatz_nr": pd.Series(positions, dtype="int32")})

    source = pages.where(f"`{key}` is not null").selectExpr(f"cast(`{key}` as bigint) as k", f"`{blocks}` as b")
    return source.mapInPandas(run, f"{key} bigint, absatz_nr int")


def article_positions(page) -> list[int]:
    """Positions of the article's own paragraphs."""
    return [i for i, label in enumerate(label_blocks(page)) if label != FURNITURE and page[i] and not page[i].isspace()] if page is not None else []
