"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed character 3- to 5-grams of the lower-cased text. Each has a log ratio of
the smoothed shares of toxic and other documents that hold it; those that lie clearly away from zero are
kept, and a logistic regression is fitted on the kept features times their ratios.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.llm.common import chunks, in_fold, map_chunks, texts, with_fields
from leaselake.session import stored

#: Labelled documents to fit on at most, the first ones by a seeded hash of doc_id.
TRAIN_ROWS = 20_000
TRAIN_TASKS = 8
SEED = 20_250_705
SIZES = (3, 4, 5)
BITS = 22
SMOOTHING = 1.0
#: Standard errors that a ratio must lie from zero, and features kept at most, the clearest ones.
CLEAR = 4.0
FEATURES = 4096
STEPS = 1000
PENALTY = 1e-3
PIECE = 1 << 20
FOLDS, HELD_OUT = 5, 0

_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of a text, by n-gram size and piece, with repeats. White space counts as a blank.

    The text has a blank before and behind it; a piece gives the n-grams that begin in it.
    """
    padded = f" {text.lower()} " if text else ""
    for start in range(0, len(padded), PIECE):
        piece = padded[start : start + PIECE + max(SIZES) - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), "<u4")
        codes = np.where(codes <= 32, np.uint32(32), codes)
        rolled = codes
        for size in range(2, max(SIZES) + 1):
            if len(codes) < size:
                break
            rolled = rolled[:-1] * _STEP + codes[size - 1 :]
            if size in SIZES:
                begun = rolled[:PIECE]
                mixed = (begun ^ (begun >> np.uint32(15))) * _MIX
                yield mixed >> np.uint32(32 - BITS)


class Model:
    """Feature numbers, sorted, with their weights, and the intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float):
        self.features, self.weights, self.intercept = features, weights, intercept
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.features, self.weights, self.intercept

    def __setstate__(self, state):
        self.__init__(*state)

    def present(self, text: str) -> np.ndarray:
        """Places of the features that a text holds, each once."""
        if self._table is None:
            self._table = np.zeros(1 << BITS, dtype=np.int16)
            self._table[self.features] = np.arange(1, len(self.features) + 1)
        found = [hits[hits > 0] for hits in (self._table[g] for g in grams(text))]
        return np.unique(np.concatenate(found)) - 1 if found else np.zeros(0, dtype=np.int16)

    def score(self, text: str) -> float:
        margin = self.intercept + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -60, 60))))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int = TRAIN_ROWS) -> DataFrame:
    """Texts and labels to fit on. A key labelled twice takes the larger label; null and held-out keys are left out."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~in_fold(key, FOLDS, HELD_OUT))
        .groupBy(F.col(key).alias("doc_id")).agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(limit)
    )
    # The chosen keys are bounded by ``limit``, so they are broadcast and no other text moves.
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")


def ratios(rows: DataFrame) -> list[tuple[int, float]]:
    """Clear features and their log ratios, from how many documents of each label hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for part in chunks(batch, "text"):
                for text, y in zip(texts(part), part.column(1).to_pylist()):
                    found = list(grams(text))
                    if found:
                        held[y, np.unique(np.concatenate(found))] += 1
        some = np.flatnonzero(held.any(axis=0))
        for start in range(0, len(some), 1 << 16):
            s = some[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s, pa.int32()), pa.array(held[0, s], pa.int64()), pa.array(held[1, s], pa.int64())],
                ["feature", "other", "toxic"],
            )

    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return []
    counts = rows.mapInArrow(count, "feature int, other long, toxic long").groupBy("feature").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic")
    )
    share = lambda name, total: (F.col(name) + SMOOTHING) / (total + 2 * SMOOTHING)
    ratio = F.log(share("toxic", n[1]) / share("other", n[0]))
    error = F.sqrt(1 / (F.col("toxic") + SMOOTHING) + 1 / (F.col("other") + SMOOTHING))
    clear = counts.select("feature", ratio.alias("ratio"), (F.abs(ratio) / error).alias("z")).where(F.col("z") >= CLEAR)
    return [(r.feature, r.ratio) for r in clear.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]


def _regression(places: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of present features (ratio included) and intercept: logistic regression by accelerated gradient steps."""
    owner = np.repeat(np.arange(len(y)), [len(p) for p in places])
    at = np.concatenate(places).astype(np.int64)
    n, toxic = len(y), max(1, int(y.sum()))
    # Each feature counts in units of its own size, so that one step length suits all.
    scale = np.sqrt(np.bincount(at, weights=ratio[at] ** 2, minlength=len(ratio)) / n) + 1e-3
    unit = ratio / scale
    step = 4 / (np.bincount(owner, weights=unit[at] ** 2, minlength=n).max() + 1)
    weight, bias, momentum = np.zeros(len(ratio)), float(np.log(toxic / max(1, n - toxic))), 1.0
    look, look_bias = weight, bias
    for _ in range(STEPS):
        margin = np.bincount(owner, weights=(look * unit)[at], minlength=n) + look_bias
        error = 1 / (1 + np.exp(-np.clip(margin, -60, 60))) - y
        gradient = np.bincount(at, weights=error[owner], minlength=len(ratio)) * unit / n + PENALTY * look
        new, new_bias = look - step * gradient * n / toxic, look_bias - step * error.mean()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / following
        look, look_bias = new + push * (new - weight), new_bias + push * (new_bias - bias)
        weight, bias, momentum = new, new_bias, following
    return weight * unit, float(bias)


def learn(rows: DataFrame) -> Model:
    """Fit on rows of text and label ``y``, at most TRAIN_ROWS of them from ``training_rows``.

    Ratios are counted by Spark; of each document only the kept features it holds reach the driver. With no
    clear feature, or one label only, the model is the share of toxic rows (one half without any row).
    """
    clear = sorted(ratios(rows))
    features = np.array([f for f, _ in clear], dtype=np.int64)
    bare = Model(features, np.zeros(len(features)), 0.0)

    def look_up(part: pa.RecordBatch) -> pa.RecordBatch:
        held = [bare.present(t) for t in texts(part)]
        return pa.RecordBatch.from_arrays([part.column(1), pa.array(held, pa.list_(pa.int16()))], ["y", "held"])

    got = map_chunks(rows, look_up, "y int, held array<smallint>").collect()
    # Fitted in one order, whatever order the rows come in.
    got = sorted((r.y, tuple(r.held)) for r in got)
    y = np.array([r[0] for r in got], dtype=np.float64)
    if not clear:
        share = float(y.mean()) if len(y) else 0.5
        return Model(features, bare.weights, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    places = [np.array(r[1], dtype=np.int16) for r in got]
    return Model(features, *_regression(places, y, np.array([r for _, r in clear])))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability of being toxic to every row; null text counts as empty.

    No shuffle. A column of that name is replaced; others are kept.
    """
    kept = docs.drop(name)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(t) for t in texts(part, text)]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, name])

    return map_chunks(kept, run, with_fields(kept, f"{name} double"), text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the labels outside one fold.

    Documents with a null doc_id are in no fold and have no label; they are scored as not held out.
    """
    rows = stored(training_rows(docs, labels, "doc_id", "text", "toxic").repartition(TRAIN_TASKS), "toxicity")
    model = learn(rows)
    scored = score(docs.select("doc_id", "text", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
