"""Mixing sources to target weights (problem 8): soft-membership mixing.

1.  Documents of the listed sources are tokenised once; id counts per source,
    hashed to a fixed number of features and summed over all of them, make the
    table of a naive Bayes classifier.
2.  The classifier gives each document a posterior over the sources, tempered
    by the document's length; the source label is evidence with a small error
    rate, so a posterior says where the document's tokens count.
3.  Projected gradient descent on least squares finds a rate per document whose
    expected tokens per domain match the targets.  Feasible rates lie between 0
    and the cap of their source and give every label its target; the projection
    is part of the descent, nothing is rescaled after it.  A document's rate after t steps follows from its own row and
    the t residuals so far, a few numbers per step; so no step carries state
    and each is one aggregation of one number per source.
4.  Rates become whole uses: the whole part for all, one more for the documents
    first in a seeded order scaled by the fractional part, until the source has
    its tokens.  The cut is found by narrowing a histogram of the order, so no
    source is sorted or gathered in one task.

The mix is the largest one in which every source that has documents can hold
its share without exceeding its cap; sources without documents reach 0 and the
others keep their proportions.

Defined results: null and empty texts have no tokens and are not used; sources
with a null or negative target or cap below 1 are left out; with no usable
source the results are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.llm.encode import TOKENIZER, encoder
from quellwerk.session import materialise

#: Features of the classifier, error rate of a label, most the words count for, steps of the fit, those kept for projections only, residual that ends them.
FEATURES, LABEL_ERROR, EVIDENCE, STEPS, PROJECTIONS, SLACK = 1024, 0.02, 20.0, 14, 4, 1e-4
MOST_SOURCES, BINS, FEW, PASSES = 10_000, 256, 200, 12


def _targets(targets: DataFrame) -> pd.DataFrame:
    """The target table on the driver; its size is checked."""
    t = targets.where("source is not null and ziel_anteil >= 0 and max_wiederholung >= 1").groupBy("source").agg(F.max("ziel_anteil").alias("share"), F.max("max_wiederholung").alias("cap"))
    rows = t.orderBy("source").limit(MOST_SOURCES + 1).toPandas()
    if len(rows) > MOST_SOURCES:
        raise ValueError("the target table is meant to be small")
    return rows


def tokenised(docs: DataFrame, sources: list[str], tokenizer: str) -> DataFrame:
    """doc_id, q (number of the source), n (tokens), f (feature ids of the tokens)."""
    number = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            flat, offsets = enc.encode(batch.column(2).to_pylist())
            features = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((flat % FEATURES).astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), features], names=["doc_id", "q", "n", "f"])

    used = docs.where(F.col("source").isin(sources) & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    return used.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.element_at(number, F.col("source")).alias("q"), "text").mapInArrow(run, "doc_id bigint, q int, n bigint, f array<smallint>")


def _classifier(tokens: DataFrame, k: int) -> np.ndarray:
    """log P(feature | source), from the counts of all documents: features x sources."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * FEATURES, np.int64)
        for batch in batches:
            q, f = batch.column(0).to_numpy(), batch.column(1)
            total += np.bincount(np.repeat(q, f.value_lengths().to_numpy()).astype(np.int64) * FEATURES + f.flatten().to_numpy(), minlength=k * FEATURES)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "c"])

    # at most sources x FEATURES rows reach the driver
    rows = tokens.select("q", "f").mapInArrow(count, "cell bigint, c bigint").groupBy("cell").agg(F.sum("c").alias("c")).toPandas()
    table = np.full(k * FEATURES, 0.5)
    table[rows["cell"].to_numpy(np.int64)] += rows["c"].to_numpy()
    table = table.reshape(k, FEATURES)
    return np.log(table / table.sum(1, keepdims=True)).T


def _posteriors(tokens: DataFrame, logp: np.ndarray, log_prior: np.ndarray) -> DataFrame:
    """doc_id, q, n, p (posterior over the sources)."""
    k = logp.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, n, f = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            sizes = f.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(q)), sizes)
            counts = np.zeros((len(q), FEATURES), np.float32)
            np.add.at(counts, (owner, f.flatten().to_numpy()), 1)
            score = counts @ logp / np.maximum(n, 1)[:, None] * np.sqrt(np.maximum(n, 1))[:, None] + log_prior
            label = np.full((len(q), k), np.log(LABEL_ERROR / max(1, k - 1)))
            label[np.arange(len(q)), q] = np.log1p(-LABEL_ERROR)
            # a label is evidence like the words; the bound only keeps the sums finite
            score = np.clip(score - score.max(1, keepdims=True), -EVIDENCE, 0) + label
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * k), pa.array(p.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], names=["doc_id", "q", "n", "p"])

    return tokens.mapInArrow(run, "doc_id bigint, q int, n bigint, p array<float>")


#: A step of the fit: a gradient per domain that moves rates by their posterior, and a shift per label.
Step = tuple[np.ndarray, np.ndarray]


def _rates(p: np.ndarray, q: np.ndarray, caps: np.ndarray, steps: list[Step], start: np.ndarray) -> np.ndarray:
    """Rates of documents after the steps so far: a function of their own rows."""
    cap = caps[q]
    r = np.minimum(p @ start, cap)
    for gradient, shift in steps:
        r = np.clip(r - p @ gradient + shift[q], 0, cap)
    return r


def _expected(posteriors: DataFrame, caps: np.ndarray, steps: list[Step], start: np.ndarray) -> np.ndarray:
    """Under the current rates: expected tokens per domain, tokens per label, and of these labels the tokens that can rise and that can fall."""
    k = len(caps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k))
        for batch in batches:
            q, n, p = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(-1, k)
            r = _rates(p, q, caps, steps, start)
            total[0] += (n * r) @ p
            for i, of in enumerate((n * r, n * (r < caps[q]), n * (r > 0)), 1):
                total[i] += np.bincount(q, of, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 * k)), pa.array(total.ravel())], names=["d", "t"])

    rows = posteriors.select("q", "n", "p").mapInArrow(run, "d bigint, t double").groupBy("d").agg(F.sum("t").alias("t")).toPandas()  # four rows per source
    out = np.zeros(4 * k)
    out[rows["d"].to_numpy(np.int64)] = rows["t"]
    return out.reshape(4, k)


def fit(posteriors: DataFrame, have: np.ndarray, goal: np.ndarray, caps: np.ndarray) -> tuple[list[Step], np.ndarray]:
    """Steps of the projected gradient and the starting rate per domain.

    Rates are feasible if they lie between 0 and their cap and every label's tokens sum up to its goal.  A step moves
    the rates against the gradient of the squared residuals of the domains; the projection shifts the rates of a label
    by one number until its tokens are right.  Both are scaled by the tokens that can move, so that a step moves a total
    by its residual where no further bound is met.
    """
    scale, none = np.maximum(have, 1.0), np.zeros(len(have))
    start, steps = np.minimum(goal / scale, caps), []
    enough = SLACK * goal.sum()
    for turn in range(STEPS):
        domains, labels, rise, fall = _expected(posteriors, caps, steps, start)
        missing = goal - labels
        feasible = np.abs(missing).max() <= enough
        if feasible and (np.abs(domains - goal).max() <= enough or turn >= STEPS - PROJECTIONS):
            break
        steps.append(((domains - goal) / scale, none) if feasible else (none, missing / np.maximum(np.where(missing > 0, rise, fall), 1.0)))
    return steps, start


def _uses(rated: DataFrame, need: np.ndarray) -> DataFrame:
    """doc_id, q, n, uses from doc_id, q, n, whole, z: one more use for the documents with the smallest z, until a source has its need."""
    k = len(need)
    low, high, left = np.zeros(k), np.full(k, 64.0), need.astype(float).copy()
    bounds = lambda a: F.element_at(F.array(*[F.lit(float(x)) for x in a]), F.col("q") + 1)
    for turn in range(PASSES + 1):
        width = np.maximum((high - low) / BINS, 1e-300)
        inside = rated.where((F.col("z") >= bounds(low)) & (F.col("z") < bounds(high)))
        at = F.least(F.floor((F.col("z") - bounds(low)) / bounds(width)), F.lit(BINS - 1))
        # at most BINS rows a source
        h = inside.groupBy("q", at.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("c")).toPandas().sort_values(["q", "b"])
        most = 0
        for q, part in h.groupby("q"):
            filled = part["n"].cumsum()
            full = filled <= left[q]
            cut = part[~full]
            taken = int(full.sum())
            b = int(cut["b"].iloc[0]) if len(cut) else BINS
            left[q] -= float(filled.iloc[taken - 1]) if taken else 0.0
            low[q], high[q] = low[q] + b * width[q], min(high[q], low[q] + (b + 1) * width[q]) if len(cut) else high[q]
            if not len(cut):
                low[q] = high[q]
            most = max(most, int(cut["c"].iloc[0]) if len(cut) else 0)
        if most <= FEW:
            break
        if turn == PASSES:
            raise ValueError("too many documents at one place of the order")  # the order is a hash of 40 bits
    edge = rated.where((F.col("z") >= bounds(low)) & (F.col("z") < bounds(high))).select("doc_id", "q", "n", "z").toPandas().sort_values(["q", "z", "doc_id"])  # at most FEW rows a source
    chosen: list[int] = []
    for q, part in edge.groupby("q"):
        taken = 0
        for doc, n in zip(part["doc_id"].tolist(), part["n"].tolist()):
            if taken + n / 2 <= left[q]:  # comes nearer to the need; a long document is passed over
                taken += n
                chosen.append(doc)
    more = (F.col("z") < bounds(low)) | F.col("doc_id").isin(chosen) if chosen else F.col("z") < bounds(low)
    return rated.select("doc_id", "q", "n", (F.col("whole") + more.cast("int")).alias("uses"))


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(uses, report): doc_id, source, n_tokens, verwendungen of every document used; and per source
    ziel_anteil, ist_anteil, tokens, tokens_vorhanden, dokumente, meiste_verwendungen.
    """
    spark = docs.sparkSession
    goals = _targets(targets)
    sources = goals["source"].tolist()
    out_uses = "doc_id bigint, source string, n_tokens bigint, verwendungen int"
    out_report = "source string, ziel_anteil double, ist_anteil double, tokens bigint, tokens_vorhanden bigint, dokumente bigint, meiste_verwendungen int"
    if not sources:
        return spark.createDataFrame([], out_uses), spark.createDataFrame([], out_report)
    k, caps = len(sources), goals["cap"].to_numpy(float)
    tokens = materialise(tokenised(docs, sources, tokenizer), "tokens")
    stock = tokens.groupBy("q").agg(F.sum("n").alias("n"), F.count("*").alias("c")).toPandas()  # one row per source
    have, number = np.zeros(k), np.zeros(k)
    have[stock["q"]], number[stock["q"]] = stock["n"], stock["c"]
    share = np.where(have > 0, goals["share"].to_numpy(float), 0.0)
    if share.sum() > 0:
        share = share / share.sum()
    held = share > 0
    size = float((have[held] * caps[held] / share[held]).min()) if held.any() else 0.0
    goal = share * size
    logp = _classifier(tokens, k)
    posteriors = materialise(_posteriors(tokens, logp, np.log(np.maximum(number, 1) / max(1, number.sum()))), "posteriors")
    steps, start = fit(posteriors, have, goal, caps)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(1).to_numpy()
            r = _rates(batch.column(3).flatten().to_numpy().reshape(-1, k), q, caps, steps, start)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(r)], names=["doc_id", "q", "n", "r"])

    rated = posteriors.mapInArrow(rate, "doc_id bigint, q int, n bigint, r double").where("n > 0")
    cap_of = F.element_at(F.array(*[F.lit(int(c)) for c in caps]), F.col("q") + 1)
    chance = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    part = F.col("r") - F.col("whole")
    rated = rated.withColumn("whole", F.floor(F.col("r") + 1e-9).cast("int"))
    # a document at its cap is never used once more
    rated = materialise(rated.withColumn("z", F.when(F.col("whole") >= cap_of, F.lit(1e9)).otherwise(chance / F.greatest(part, F.lit(1 / 64)))), "rates")
    whole = rated.groupBy("q").agg(F.sum(F.col("whole") * F.col("n")).alias("t")).toPandas()
    need = goal.copy()
    need[whole["q"]] -= whole["t"].to_numpy(float)
    name = F.element_at(F.array(*[F.lit(s) for s in sources]), F.col("q") + 1)
    chosen = materialise(_uses(rated, np.maximum(need, 0)).where("uses > 0"), "uses")
    uses = chosen.select("doc_id", name.alias("source"), F.col("n").alias("n_tokens"), F.col("uses").alias("verwendungen"))
    done = chosen.groupBy("q").agg(F.sum(F.col("n") * F.col("uses")).alias("t"), F.count("*").alias("c"), F.max("uses").alias("m")).toPandas()  # one row per source
    got, docs_used, most = np.zeros(k), np.zeros(k), np.zeros(k)
    got[done["q"]], docs_used[done["q"]], most[done["q"]] = done["t"], done["c"], done["m"]
    rows = [
        (s, float(g), float(t / max(1.0, got.sum())), int(t), int(h), int(c), int(m))
        for s, g, t, h, c, m in zip(sources, goals["share"], got, have, docs_used, most)
    ]
    return uses, spark.createDataFrame(rows, out_report)
