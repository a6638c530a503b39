"""Quality score: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters (with their case shape), digits or signs, hashed into ``SLOTS``
slots.  Each slot has a fixed sparse index vector of two entries of +1 or -1.  A slot's word vector
is the sum of the index vectors of the tokens beside its occurrences, over all documents: integer
sums, added up per task and then per slot, so the table has a fixed size whatever the corpus.
Rows are scaled to unit length.

A document is pooled to the mean of its tokens' vectors, the mean of their squares, the share of
each token class, the shares of tokens equal to the last and to the last but one (a word repeated
without end), and the share of distinct tokens.  A network with one hidden layer (numpy, Adam) is fitted on at most ``SAMPLE``
labelled rows (lowest hash of the id); a third of them is held back to choose the number of rounds
and the temperature by which the outputs are divided, so that scores are probabilities.

Cases: null and empty texts pool to zero vectors and are scored like any other; without labels every
score is 0.5; repeated rows are scored alike; a doc_id labelled twice counts by its highest label;
extra columns pass through, one named like an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import LOWERED, Stored, append, blocks, in_part, mix64, one_per_id, powers, query, table, text_bytes

SLOTS = 1 << 13
SIZE = 32
HIDDEN = 24
SAMPLE = 20_000
THRESHOLD = 0.3
_KIND = np.array([0 if b == 32 or 9 <= b <= 13 else 2 if 48 <= b < 58 else 1 if b >= 128 or chr(b).isalpha() else 3 for b in range(256)], np.int8)
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_INDEX = mix64(np.arange(SLOTS, dtype=np.uint64) ^ np.uint64(0x51ED270B))
PLACES = np.stack([(_INDEX >> np.uint64(8)) % np.uint64(SIZE), (_INDEX >> np.uint64(24)) % np.uint64(SIZE)], 1).astype(np.int64)
SIGNS = np.stack([(_INDEX & np.uint64(1)), (_INDEX >> np.uint64(1)) & np.uint64(1)], 1).astype(np.int64) * 2 - 1
SHAPES = 6      # lower, capital, upper and mixed letters; digits; signs


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(document, slot, shape) of each token of a block."""
    n = len(data)
    kind = _KIND[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LOWERED[data] * up[:n], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    upper = np.zeros(n + 1, np.int64)
    np.cumsum(_UPPER[data], out=upper[1:])
    capitals = upper[end] - upper[start]
    shape = np.select([kind[start] == 2, kind[start] == 3, capitals == 0, (capitals == 1) & _UPPER[data[start]] & (end - start > 1), capitals == end - start],
                      [4, 5, 0, 1, 2], 3)
    slot = (mix64(value ^ (shape.astype(np.uint64) << np.uint64(3))) >> np.uint64(51)).astype(np.int64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return doc, slot, shape


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vectors by slot, from neighbours in all texts."""
    def count(batches):
        total = np.zeros(SLOTS * SIZE)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            for i, j in blocks(offsets):
                doc, slot, _ = tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                same = doc[1:] == doc[:-1]
                left, right = slot[:-1][same], slot[1:][same]
                for own, other in ((left, right), (right, left)):
                    for k in range(2):
                        total += np.bincount(own * SIZE + PLACES[other, k], SIGNS[other, k], minlength=SLOTS * SIZE)
        grid = total.astype(np.int64).reshape(SLOTS, SIZE)
        rows = np.flatnonzero(grid.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows)] + [pa.array(np.ascontiguousarray(grid[rows, c])) for c in range(SIZE)], names)
    names = ["slot"] + [f"v{c}" for c in range(SIZE)]
    parts = docs.select(text).mapInArrow(count, ", ".join(f"{name} long" for name in names))
    out = np.zeros((SLOTS, SIZE))
    for row in parts.groupBy("slot").agg(*[F.sum(name).alias(name) for name in names[1:]]).collect():       # at most SLOTS rows
        out[row["slot"]] = row[1:]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean vector, mean of squares, share of each token shape, of repeats and of distinct
    tokens, log of the token count."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(column), 2 * SIZE + SHAPES + 4), np.float32)
    for i, j in blocks(offsets):
        doc, slot, shape = tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        if not len(doc):
            continue
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        size = np.diff(np.append(first, len(doc)))
        rows = doc[first] + i
        seen = vectors[slot]
        out[rows, :SIZE] = np.add.reduceat(seen, first) / size[:, None]
        out[rows, SIZE:2 * SIZE] = np.add.reduceat(seen * seen, first) / size[:, None]
        shares = np.bincount(doc * SHAPES + shape, minlength=(j - i) * SHAPES).reshape(-1, SHAPES)[doc[first]]
        out[rows, 2 * SIZE:2 * SIZE + SHAPES] = shares / size[:, None]
        for lag, place in ((1, -4), (2, -3)):
            again = (slot[lag:] == slot[:-lag]) & (doc[lag:] == doc[:-lag])
            out[rows, place] = np.bincount(doc[lag:][again], minlength=j - i)[doc[first]] / size
        out[rows, -2] = np.bincount(np.unique(doc * SLOTS + slot) // SLOTS, minlength=j - i)[doc[first]] / size
        out[rows, -1] = np.log1p(size)
    return out


@dataclass
class QualityModel:
    """Word vectors, feature scaling, the two layers, and the temperature."""
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray] | None = None
    temperature: float = 1.0

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.zeros(len(pooled))
        a, b, c, d = self.layers
        return np.tanh((pooled - self.centre) / self.spread @ a + b) @ c + d

    def score(self, column: pa.Array) -> np.ndarray:
        return _chance(self.margin(pool(column, self.vectors).astype(np.float64)) / self.temperature)


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _loss(margin: np.ndarray, label: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, margin) - label * margin))


def fit_network(x: np.ndarray, y: np.ndarray, model: QualityModel, most: int = 40, batch: int = 128, seed: int = 5) -> None:
    """Fits the layers by Adam on two thirds; the last third picks rounds and temperature."""
    rng = np.random.default_rng(seed)
    if not len(y):
        return
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-6
    held = np.arange(len(y)) % 3 == 2 if len(y) >= 30 else np.zeros(len(y), bool)
    own, check = ~held, held if held.any() else ~held
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.array(0.0)]
    z, best, step = (x[own] - model.centre) / model.spread, (np.inf, None), 0
    mean, square = [0.0] * 4, [0.0] * 4
    target = y[own]
    for _ in range(most):
        order = rng.permutation(len(target))
        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            hidden = np.tanh(z[some] @ layers[0] + layers[1])
            error = (_chance(hidden @ layers[2] + layers[3]) - target[some]) / len(some)
            back = np.outer(error, layers[2]) * (1 - hidden * hidden)
            grads = [z[some].T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error + 1e-4 * layers[2], error.sum()]
            step += 1
            for k, g in enumerate(grads):
                mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * square[k] + 0.001 * g * g
                layers[k] = layers[k] - 0.005 * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
        model.layers = layers
        now = _loss(model.margin(x[check]), y[check])
        if now < best[0]:
            best = (now, [np.copy(a) for a in layers])
    model.layers = best[1]
    margin = model.margin(x[check])
    model.temperature = float(min(np.geomspace(0.5, 5, 46), key=lambda t: _loss(margin / t, y[check])))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
          learn: Column | None = None, sample: int = SAMPLE) -> QualityModel:
    """Word vectors from all of ``docs``, the network from labelled rows for which ``learn`` holds."""
    vectors = word_vectors(docs, text)
    model = QualityModel(vectors, np.zeros(1), np.ones(1))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    chosen = (chosen if learn is None else chosen.where(learn)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(sample).withColumnRenamed(key, "id")

    def pooled(batch):
        return [pa.array(list(pool(batch.column("text"), shared.value.vectors).astype(np.float64)), pa.list_(pa.float64()))]
    learned = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = append(one_per_id(learned, "id", "text", "label"), "pooled array<double>", pooled)
    stored = Stored(rows.select("id", "label", "pooled"), "quality-sample")
    held = stored.read().orderBy(F.xxhash64("id"), "id", "pooled").collect()
    stored.drop()
    fit_network(np.array([r["pooled"] for r in held], float), np.array([r["label"] for r in held], float), model)
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, "score double", lambda batch: [pa.array(shared.value.score(batch.column(text)))])


@query("op5_quality")
def op5_quality(spark, folder):
    """Every document scored; labels of one fold in five are not learned from."""
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"), learn=~in_part(0, 5))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", in_part(0, 5).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
