"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of ``WINDOW`` bytes, rectified
outputs are pooled by their maximum, and a softmax over the pooled values gives the languages.  An
embedding followed by a filter is linear, so each filter tap is a table of 256 values; a window is
looked up and added, tap by tap.  Training is plain numpy with Adam on the driver, on windows of at
most ``SAMPLE`` labelled rows (lowest hash of the id).

A text is covered by windows that overlap by one filter width less one byte, however long it is;
the languages' probabilities are averaged over the windows, weighted by their letters.

Cases: null texts and texts without a letter are ``und`` with score 0; without any labelled row all
texts are; repeated rows get the same answer; a label of null is not learned from; extra columns
pass through, those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import append, in_part, one_per_id, query, table, text_bytes

WINDOW = 192
WIDTHS = (2, 3, 4, 5)
FILTERS = 8             # of each width
EMBEDDING = 8
SAMPLE = 3000           # labelled rows learned from
PER_TEXT = 3            # training windows of a text, spread over its length
ROUNDS = 4
UNKNOWN = "und"
STEP = WINDOW - max(WIDTHS) + 1
_WEIGHT = np.array([1 if (chr(b).isalpha() and b < 128) or b >= 128 else 0 for b in range(256)], np.int64)


@dataclass
class Network:
    """Languages, tap tables (256 x taps x filters, one array per width), biases, output layer."""
    languages: list[str]
    taps: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray):
        """Maxima over each window, and where they are."""
        values, places = [], []
        for taps, bias in zip(self.taps, self.bias):
            width = taps.shape[1]
            reach = windows.shape[1] - width + 1
            total = taps[windows[:, :reach], 0]
            for t in range(1, width):
                total += taps[windows[:, t:t + reach], t]
            place = total.argmax(1)
            values.append(np.maximum(np.take_along_axis(total, place[:, None], 1)[:, 0] + bias, 0))
            places.append(place)
        return np.concatenate(values, 1), places

    def chances(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows)[0] @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_network(windows: np.ndarray, label: np.ndarray, languages: list[str], rounds: int = ROUNDS, batch: int = 64, seed: int = 7) -> Network:
    """Adam on cross entropy; languages count alike, whatever their share of the sample."""
    rng = np.random.default_rng(seed)
    n_out, n_pooled = len(languages), FILTERS * len(WIDTHS)
    values = {"embed": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.2, (n_pooled, n_out)), "out_bias": np.zeros(n_out)}
    for w in WIDTHS:
        values[f"filter{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
        values[f"bias{w}"] = np.zeros(FILTERS)
    mean, square, step = {k: 0.0 for k in values}, {k: 0.0 for k in values}, 0
    share = len(label) / (n_out * np.maximum(np.bincount(label, minlength=n_out), 1))

    def network():
        return Network(languages, [np.einsum("be,tef->btf", values["embed"], values[f"filter{w}"]).astype(np.float32) for w in WIDTHS],
                       [values[f"bias{w}"].astype(np.float32) for w in WIDTHS], values["out"], values["out_bias"])

    for _ in range(rounds):
        order = rng.permutation(len(label))
        for i in range(0, len(order), batch):
            x, y = windows[order[i:i + batch]], label[order[i:i + batch]]
            pooled, places = network().pooled(x)
            error = softmax(pooled @ values["out"] + values["out_bias"])
            error[np.arange(len(y)), y] -= 1
            error *= (share[y] / len(y))[:, None]
            grad = {"out": pooled.T @ error, "out_bias": error.sum(0), "embed": np.zeros((256, EMBEDDING))}
            back = (error @ values["out"].T) * (pooled > 0)
            for w, place, part in zip(WIDTHS, places, np.split(back, len(WIDTHS), 1)):
                seen = x[np.arange(len(y))[:, None, None], place[:, :, None] + np.arange(w)]          # text, filter, tap
                grad[f"bias{w}"] = part.sum(0)
                grad[f"filter{w}"] = np.einsum("nf,nfte->tef", part, values["embed"][seen], optimize=True)
                flow = np.einsum("nf,tef->nfte", part, values[f"filter{w}"], optimize=True)
                np.add.at(grad["embed"], seen.ravel(), flow.reshape(-1, EMBEDDING))
            step += 1
            for k, g in grad.items():
                mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * square[k] + 0.001 * g * g
                values[k] = values[k] - 0.01 * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return network()


def cut_windows(data: np.ndarray, offsets: np.ndarray):
    """(windows, document): every text from end to end; the last window of a text is zero-padded."""
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(-(-(size - WINDOW) // STEP), 0) + 1, 0)
    doc = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STEP + offsets[:-1][doc]
    place = start[:, None] + np.arange(WINDOW)
    padded = np.append(data, np.zeros(1, np.uint8))
    return padded[np.where(place < offsets[1:][doc][:, None], place, len(data))], doc


def languages_of(column: pa.Array, network: Network, at_once: int = 256):
    """(language, score) of each text."""
    data, offsets = text_bytes(column)
    total, weight = np.zeros((len(column), max(len(network.languages), 1))), np.zeros(len(column))
    i = 0 if network.languages else len(column)
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + at_once * STEP, side="right")) - 1)
        for start in range(int(offsets[i]), int(offsets[j]) or 1, 64 * at_once * STEP):      # pieces of one very long text
            stop = min(int(offsets[j]), start + 64 * at_once * STEP + WINDOW - STEP)
            windows, doc = cut_windows(data[start:stop], np.clip(offsets[i:j + 1], start, stop) - start)
            for k in range(0, len(doc), at_once):
                some, own = windows[k:k + at_once], doc[k:k + at_once] + i
                letters = _WEIGHT[some].sum(1)
                np.add.at(total, own, network.chances(some) * letters[:, None])
                np.add.at(weight, own, letters)
        i = j
    texts = None
    found, score = [], []
    for n in range(len(column)):
        known = weight[n] > 0 and len(network.languages) > 0
        if known:
            own = data[offsets[n]:offsets[n + 1]]
            ascii_letter = ((own | 32) >= 97) & ((own | 32) <= 122) & (own < 128)
            if not ascii_letter.any():
                texts = column.to_pylist() if texts is None else texts
                known = any(c.isalpha() for c in texts[n])
        best = int(total[n].argmax())
        found.append(network.languages[best] if known else UNKNOWN)
        score.append(float(total[n, best] / weight[n]) if known else 0.0)
    return found, score


def fit(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", learn: Column | None = None, sample: int = SAMPLE) -> Network:
    """Trains on a bounded sample of the rows that satisfy ``learn`` and have label and text."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows if learn is None else rows.where(learn)

    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            windows, names = [], []
            for n, name in enumerate(batch.column(label).to_pylist()):
                own = data[offsets[n]:offsets[n + 1]]
                if not _WEIGHT[own].any():
                    continue
                for start in sorted({int(x) for x in np.linspace(0, max(len(own) - WINDOW, 0), PER_TEXT)}):
                    windows.append(own[start:start + WINDOW].tobytes())
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(windows, pa.binary())], ["label", "window"])
    chosen = rows.select(key).orderBy(F.xxhash64(key), key).limit(sample).withColumnRenamed(key, "_id").distinct()
    learned = one_per_id(rows.join(F.broadcast(chosen), F.col(key) == F.col("_id")), "_id", text, label)
    held = learned.select(label, text).mapInArrow(cut, "label string, window binary").collect()
    held = sorted((r["label"], bytes(r["window"])) for r in held)
    languages = sorted({name for name, _ in held})
    if not held:
        return Network([], [], [], np.zeros((0, 0)), np.zeros(0))
    windows = np.zeros((len(held), WINDOW), np.uint8)
    for n, (_, raw) in enumerate(held):
        windows[n, :len(raw)] = np.frombuffer(raw, np.uint8)
    return train_network(windows, np.array([languages.index(name) for name, _ in held]), languages)


def identify(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return append(docs, "lang_pred string, score double", lambda batch: list(languages_of(batch.column(text), shared.value)))


@query("op1_language_id")
def op1_language_id(spark, folder):
    """Language of every document; one fold in four is not learned from."""
    docs = table(spark, folder, "documents")
    network = fit(docs, learn=~in_part(2, 4))
    return identify(docs.select("doc_id", "text"), network).select("doc_id", in_part(2, 4).alias("held_out"), "lang_pred", "score")
