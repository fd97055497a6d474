"""Quality scores: random-indexing word vectors, pooled, then a two-layer network, calibrated."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import arrow_bounds, held_out
from gradeline.llm.tokens import Bounded

#: Units are hashed to so many vectors of so many dimensions; an index vector has so many signs.
UNITS, DIM, SIGNS, REACH = 1 << 13, 48, 6, 3
#: Slices in which partial vector sums travel.
PARTS = 16
#: Units pooled at once in a worker, and units whose pairs are counted at once.
CHUNK, PAIRED = 1 << 17, 1 << 19

_SHAPES = [(re.compile(p), r) for p, r in (
    (r"[A-Z\xc0-\xd6\xd8-\xde]+", "A"), (r"[a-z\xdf-\xf6\xf8-\xff]+", "a"), (r"[0-9]+", "0"), (r"([^A-Za-z0-9])\1+", r"\1"),
)]
_EDGE = re.compile(r"^\W+|\W+$")


def _unit(word: bytes) -> int:
    """Two hashed units of a word in one integer: its lower-cased core and its shape."""
    text = word.decode("utf-8", "replace")
    shape = text
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    core = _EDGE.sub("", text.lower())
    return crc32(core.encode()) % UNITS * UNITS + crc32(shape.encode(), 77) % UNITS


@lru_cache(maxsize=1)
def _units() -> Bounded:
    return Bounded(_unit, 300_000)


def units(data: bytes) -> tuple[np.ndarray, int, int]:
    """Units of a text in order (core, shape, core, shape, ...), its words and distinct words."""
    words = data.split()
    both = np.array(_units().values(words), dtype=np.int64)
    out = np.empty(2 * len(words), np.int64)
    out[0::2], out[1::2] = both // UNITS, both % UNITS
    return out, len(words), len(set(words))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the sparse index vector of each unit; fixed by a seed."""
    rng = np.random.default_rng(20)
    places = np.argsort(rng.random((UNITS, DIM)), axis=1)[:, :SIGNS]
    return places, rng.choice([-1.0, 1.0], size=(UNITS, SIGNS))


def context_sums(texts: Iterable[bytes], places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sum, for each unit of the texts, of the index vectors of the units near it in its text.

    Equal pairs of near units are counted first, as a few make up most of them; each distinct pair
    then adds its count times the signs. All sums are whole numbers, so their order does not matter.
    """
    total = np.zeros((UNITS + 1) * DIM)
    # Rows of zeros for a unit that parts texts, so that all are gone through at once.
    places = np.vstack([places, np.zeros((1, SIGNS), places.dtype)])
    signs = np.vstack([signs, np.zeros((1, SIGNS))])
    gap_units = np.full(REACH, UNITS, np.uint32)
    base = np.uint32(UNITS + 1)
    held: list[np.ndarray] = []
    size = 0

    def add(seq: np.ndarray) -> None:
        for at in range(0, len(seq), PAIRED):
            part = seq[at : at + PAIRED + REACH]
            near = [(part[:-gap][:PAIRED], part[gap:][:PAIRED]) for gap in range(1, REACH + 1)]
            keys = np.concatenate([np.minimum(a, b) * base + np.maximum(a, b) for a, b in near])
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            times = np.diff(np.append(first, len(keys)))
            a, b = (x.astype(np.int64) for x in np.divmod(keys[first], base))
            for k in range(SIGNS):
                total[:] += np.bincount(a * DIM + places[b, k], times * signs[b, k], len(total))
                total[:] += np.bincount(b * DIM + places[a, k], times * signs[a, k], len(total))

    for data in texts:
        held += [units(data)[0].astype(np.uint32), gap_units]
        size += len(held[-2]) + REACH
        if size >= PAIRED:
            add(np.concatenate(held))
            held, size = [], 0
    if held:
        add(np.concatenate(held))
    return total[: UNITS * DIM]


@dataclass
class QualityModel:
    """Word vectors, feature scales, two layers and a temperature; of fixed size."""

    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.spread
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(features) / self.temperature, -40, 40)
        return 1 / (1 + np.exp(-z))


def pooled(data: bytes, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of a whole text, log of its words, share of distinct words."""
    seq, words, distinct = units(data)
    out = np.zeros(DIM + 2)
    for at in range(0, len(seq), CHUNK):
        out[:DIM] += vectors[seq[at : at + CHUNK]].sum(axis=0)
    out[:DIM] /= max(len(seq), 1)
    out[DIM:] = np.log1p(words), distinct / max(words, 1)
    return out


def train(features: np.ndarray, labels: np.ndarray, vectors: np.ndarray, hidden: int = 24,
          epochs: int = 40, seed: int = 3) -> QualityModel:
    """Adam on the cross-entropy over four fifths of the rows; the rest sets the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    check, use = order[: len(order) // 5], order[len(order) // 5 :]
    centre, spread = features[use].mean(axis=0), features[use].std(axis=0) + 1e-6
    shapes = [(features.shape[1], hidden), (hidden,), (hidden,), ()]
    p = [rng.normal(0, np.sqrt(2 / features.shape[1]), shapes[0]), np.zeros(hidden),
         rng.normal(0, np.sqrt(2 / hidden), shapes[2]), np.zeros(())]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(use), max(1, len(use) // 128)):
            x, y = (features[rows] - centre) / spread, labels[rows]
            h = np.maximum(x @ p[0] + p[1], 0)
            miss = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y) / len(rows)
            back = np.outer(miss, p[2]) * (h > 0)
            step += 1
            for i, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ miss, miss.sum())):
                g = g + 1e-4 * p[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, centre, spread, p[0], p[1], p[2], float(p[3]), 1.0)
    if len(check):
        z, y = model.logits(features[check]), labels[check]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality",
        ident: str = "doc_id", sample: int = 10_000) -> QualityModel:
    """Learn from at most ``sample`` labelled rows whose id is not held out.

    Those with the smallest id hashes are taken, so the sample does not depend on order. The word
    vectors need no label and are summed over the whole texts of all rows of ``docs``. Executors
    sum context vectors and pool documents; the driver gets one fixed-size table of vectors and
    one row of features per sampled document. Without labelled rows every score is 0.5.
    """
    arrow_bounds(docs.sparkSession)
    keep = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull() & ~held_out(ident))
    keep = keep.groupBy(ident).agg(F.max(label).cast("double").alias("_y"))
    keep = keep.orderBy(F.xxhash64(ident), ident).limit(sample)
    rows = docs.select(ident, F.coalesce(text, F.lit("")).cast("binary").alias("text")).join(keep, ident)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (data for batch in batches for data in batch.column(0).to_pylist())
        total = context_sums(texts, *index_vectors())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, PARTS)], pa.binary())],
            ["part", "sums"],
        )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in frame["sums"])
        return pd.DataFrame({"part": frame["part"].iloc[:1], "sums": [total.tobytes()]})

    every = docs.select(F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    part = every.mapInArrow(sums, "part int, sums binary")
    part = part.groupBy("part").applyInPandas(add, "part int, sums binary")
    found = {r.part: np.frombuffer(r.sums) for r in part.collect()}
    vectors = np.concatenate([found.get(i, np.zeros(UNITS * DIM // PARTS)) for i in range(PARTS)])
    vectors = vectors.reshape(UNITS, DIM)
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pooled(data, vectors).tobytes() for data in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), *batch.columns[1:]], ["x", "y", "h"])

    made = rows.select("text", "_y", F.xxhash64(ident).alias("h")).mapInArrow(features, "x binary, y double, h long")
    got = sorted(made.collect(), key=lambda r: (r.h, r.x))
    if not got:
        none = np.zeros(DIM + 2)
        return QualityModel(vectors, none, none + 1, np.zeros((DIM + 2, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    x = np.array([np.frombuffer(r.x) for r in got])
    return train(x, np.array([r.y for r in got]), vectors)


def score(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1, higher is better) and predicted (1 from ``threshold`` up) to each row.

    Null and empty texts are scored as texts without words.
    """
    arrow_bounds(docs.sparkSession)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        x = np.array([pooled(t, model.vectors) for t in texts]).reshape(-1, DIM + 2)
        return pd.Series(model.probability(x), dtype="float64")

    rated = docs.withColumn("score", rate(F.coalesce(text, F.lit("")).cast("binary")))
    return rated.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
