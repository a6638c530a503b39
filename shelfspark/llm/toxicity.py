"""Toxicity: noisy-channel deobfuscation, then a sparse linear score of the restored text.

1. A character trigram model is counted over every text given.
2. Suspicious spans (digits or symbols inside words, letters set apart by blanks or dots, letters
   repeated three times or more) become a lattice: each observed character may stand for itself,
   for the letters it resembles, for nothing (separators), or for fewer copies (repeats), at a
   channel cost.  Viterbi search finds the best restoration under channel and language model.
3. Words and word beginnings of the restored text are the evidence.  Each gets a precision from
   labelled rows: texts with label 1 that hold it, over all that hold it and ``PRIOR`` more.  Copies
   would make every rare word of a copied text look like evidence, so of the labelled texts with
   the same smallest 3-word shingle hash one counts.  A logistic curve over a text's best precision
   gives the score.

The model is fitted on at most ``SAMPLE`` labelled rows (lowest hash of the id) and at most
``FEATURES`` features that speak for label 1; everything else covers all rows.

Cases: null or empty text gets the score of a text without any feature; without labels every score
is the base rate; repeated rows are scored alike; a doc_id labelled twice counts by its highest
label; extra columns pass through, one named like an output is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import Stored, Words, append, blocks, in_part, mix64, one_per_id, query, runs, table, text_bytes

SAMPLE = 20_000
FEATURES = 4096
PRIOR = 8.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

# What an observed character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l"}
SEPARATORS = " .-_*/"
COST_SWAP, COST_AS_IS, COST_DROP, COST_KEEP_GAP, COST_REPEAT = 0.5, 8.0, 0.2, 6.0, 0.5

_SYMBOL = "".join(map(re.escape, LOOKALIKES))
_SINGLE = rf"[a-zA-Z{_SYMBOL}]"
SPACED = re.compile(rf"(?<![^\s.\-_*/])(?:{_SINGLE}[ .\-_*/]{{1,3}}){{3,}}{_SINGLE}(?![^\s.\-_*/,;:?!])")
MIXED = re.compile(rf"(?<!\S)(?=\S*[^\W\d_][{_SYMBOL}]+[^\W\d_]|[{_SYMBOL}]+[^\W\d_]|\S*[^\W\d_][0-9]+(?!\S)|\S*([a-zA-Z])\1\1)\S+")

LETTER = np.array([(chr(b).isalpha() if b < 128 else True) for b in range(256)])
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LOOKALIKES if ord(c) < 128]] = True
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\v\f" for b in range(256)])
_GAP = np.array([chr(b) in SEPARATORS for b in range(256)])
SYMBOLS = 28
_CLASS = np.zeros(256, np.int32)
for _b in range(26):
    _CLASS[65 + _b] = _CLASS[97 + _b] = _b + 1
_CLASS[128:] = 27


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts (letters a-z, other letters, boundary) over all texts: at most 28**3 numbers
    reach the driver."""
    def count(batches):
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            for i, j in blocks(offsets):
                size = offsets[i:j + 1] - offsets[i]
                padded = np.zeros(size[-1] + 2 * (j - i) + 2, np.int32)     # two boundaries between texts
                padded[np.arange(size[-1]) + 2 * np.repeat(np.arange(j - i), np.diff(size)) + 2] = _CLASS[data[offsets[i]:offsets[j]]]
                codes = (padded[:-2] * SYMBOLS + padded[1:-1]) * SYMBOLS + padded[2:]
                total += np.bincount(codes, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])
    rows = docs.select(text).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS ** 3)
    for row in rows:
        counts[row["code"]] = row["n"]
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Restorer:
    """Lattice search under the character model."""

    def __init__(self, counts: np.ndarray, smooth: float = 5.0):
        one = counts.sum((0, 1)) + 1.0
        one /= one.sum()
        two = counts.sum(0)
        two = (two + smooth * one) / (two.sum(1, keepdims=True) + smooth)
        three = (counts + smooth * two) / (counts.sum(2, keepdims=True) + smooth)
        self.log = np.log(three).tolist()

    @staticmethod
    def symbol(char: str) -> int:
        if "a" <= char <= "z":
            return ord(char) - 96
        return 27 if char.isalpha() else 0

    def slots(self, seen: str):
        """Per run of equal characters the ways to read it: (text, cost)."""
        out, i = [], 0
        gaps = bool(re.fullmatch(rf"{_SINGLE}(?:[ .\-_*/]+{_SINGLE})+", seen))
        while i < len(seen):
            j = i
            while j < len(seen) and seen[j] == seen[i]:
                j += 1
            char, n = seen[i], j - i
            ways = []
            if char.isalpha():
                ways.append((char * n, 0.0 if n < 3 else COST_REPEAT * 4))
                if n > 2:
                    ways.append((char * 2, COST_REPEAT))
                if n > 1:
                    ways.append((char, COST_REPEAT))
            else:
                if gaps and char in SEPARATORS:
                    ways += [("", COST_DROP), (char, COST_KEEP_GAP)] if n == 1 else [("", COST_DROP * 5), (char, COST_DROP)]
                else:
                    ways.append((char * n, COST_AS_IS if char in LOOKALIKES else 0.0))
                for letter in LOOKALIKES.get(char, ""):
                    ways.append((letter, COST_SWAP + (COST_REPEAT if n > 1 else 0)))
                    if n > 1:
                        ways.append((letter * 2, COST_SWAP + (COST_REPEAT if n > 2 else 0)))
            out.append(ways)
            i = j
        return out

    def restore(self, seen: str) -> str:
        """The likeliest reading of a span; lower case."""
        states = {(0, 0): (0.0, "")}
        for ways in self.slots(seen.lower()):
            after: dict = {}
            for (a, b), (score, text) in states.items():
                for way, cost in ways:
                    p, q, s = a, b, score - cost
                    for char in way:
                        c = self.symbol(char)
                        s += self.log[p][q][c]
                        p, q = q, c
                    held = after.get((p, q))
                    if held is None or s > held[0]:
                        after[p, q] = (s, text + way)
            states = after
        return max((score + self.log[a][b][0], text) for (a, b), (score, text) in states.items())[1]

    def text(self, text: str) -> str:
        """``text`` with its suspicious spans restored."""
        text = SPACED.sub(lambda m: self.restore(m[0]), text)
        return MIXED.sub(lambda m: self.restore(m[0]), text)


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document: might a suspicious span be in it?  A vectorised superset of the patterns."""
    n = len(data)
    if n < 3:
        return np.zeros(len(offsets) - 1, bool)
    letter, leet, space = LETTER[data], _LEET[data], _SPACE[data]
    hit = np.zeros(n, bool)
    hit[1:-1] = leet[1:-1] & (letter[2:] | leet[2:]) & (letter[:-2] | leet[:-2] | space[:-2])
    hit[:-1] |= leet[:-1] & letter[1:]
    hit[1:] |= _DIGIT[data[1:]] & letter[:-1]
    hit |= data >= 0xE2        # signs beyond Latin letters, among them money signs
    hit[:-1] |= (data[:-1] == 0xC2) & (data[1:] == 0xA3)
    hit[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & (data[2:] < 128)
    symbol = leet | (letter & (data < 128))
    alone = symbol.copy()
    alone[1:] &= ~symbol[:-1] | _GAP[data[:-1]]
    alone[:-1] &= ~symbol[1:] | _GAP[data[1:]]
    count = np.zeros(n + 1, np.int32)
    np.cumsum(alone, out=count[1:])
    reach = min(16, n)          # four single characters, at most three separators between two
    hit[:n - reach + 1] |= alone[:n - reach + 1] & (count[reach:] - count[:n - reach + 1] >= 4)
    hit[n - reach + 1:] |= alone[n - reach + 1:]
    total = np.zeros(n + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    return total[offsets[1:]] > total[offsets[:-1]]


def restored(column: pa.Array, restorer: Restorer) -> pa.Array:
    """A text column with suspicious spans restored."""
    data, offsets = text_bytes(column)
    change = np.zeros(len(column), bool)
    for i, j in blocks(offsets):
        change[i:j] = suspicious(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
    if not change.any():
        return column
    texts = column.to_pylist()
    for i in np.flatnonzero(change):
        texts[i] = restorer.text(texts[i])
    return pa.array(texts, pa.string())


def features(data: np.ndarray, offsets: np.ndarray):
    """(document, feature hash) of every word and word beginning."""
    words = Words(data, offsets, LETTER)
    docs, hashes = [words.doc], [words.hash]
    for p in PREFIXES:
        longer = np.flatnonzero(words.end - words.start > p)
        docs.append(words.doc[longer])
        hashes.append(mix64(words.upto(np.minimum(words.start + p, words.end))[longer] ^ np.uint64(p)))
    return np.concatenate(docs), np.concatenate(hashes)


def families(column: pa.Array) -> np.ndarray:
    """Smallest hash of a text's 3-word shingles (of its words, if they are fewer)."""
    data, offsets = text_bytes(column)
    out = np.zeros(len(column), np.uint64)
    for i, j in blocks(offsets):
        words = Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], LETTER)
        threes, doc = runs(words.hash, 3), words.doc[:max(len(words.doc) - 2, 0)]
        inside = doc == words.doc[2:]
        for values, doc in ((words.hash, words.doc), (threes[inside], doc[inside])):
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else doc
            if len(first):
                out[doc[first] + i] = np.minimum.reduceat(values, first)
    return out


@dataclass
class ToxicityModel:
    """Restorer, sorted feature hashes with precisions, coefficients of the logistic curve."""
    restorer: Restorer
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    precision: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: tuple[float, float] = (0.0, 0.0)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Per (restored) text the best precision of its features, 0 without any."""
        data, offsets = text_bytes(column)
        out = np.zeros(len(column))
        if not len(self.hashes):
            return out
        seen = np.zeros(1 << 16, bool)
        seen[self.hashes >> np.uint64(48)] = True
        for i, j in blocks(offsets):
            doc, value = features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            maybe = seen[value >> np.uint64(48)]
            doc, value = doc[maybe], value[maybe]
            place = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
            same = self.hashes[place] == value
            np.maximum.at(out, doc[same] + i, self.precision[place[same]])
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * self.evidence(restored(column, self.restorer)), -30, 30)))


def _feature_counts(sample: DataFrame) -> DataFrame:
    """Texts with label 1 and with label 0 that hold each feature."""
    def count(batches):
        for batch in batches:
            label = np.array(batch.column("label").to_pylist(), np.int64)
            data, offsets = text_bytes(batch.column("text"))
            for i, j in blocks(offsets):
                doc, value = features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                order = np.lexsort((doc, value))
                doc, value = doc[order], value[order]
                new = np.ones(len(doc), bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                doc, value = doc[new], value[new]
                kinds, first = np.unique(value, return_index=True)
                if len(kinds):
                    ones = np.add.reduceat(label[doc + i], first)
                    every = np.diff(np.append(first, len(value)))
                    yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(ones), pa.array(every - ones)],
                                                     ["feature", "ones", "zeros"])
    parts = sample.select("text", "label").mapInArrow(count, "feature long, ones long, zeros long")
    return parts.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def _fit(evidence: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic curve, by Newton's method with a slight ridge that keeps it from becoming a step."""
    x = np.column_stack([np.ones(len(label)), evidence])
    base = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    w, ridge = np.array([np.log(base / (1 - base)), 0.0]), np.array([1e-3, 0.1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - label) + ridge * w
        w = w - np.clip(np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(ridge), grad), -4, 4)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
          learn=None, sample: int = SAMPLE) -> ToxicityModel:
    """Counts the character model over all of ``docs`` and fits the score on labelled rows for which
    the condition ``learn`` on the key holds."""
    spark = docs.sparkSession
    restorer = Restorer(trigram_counts(docs, text))
    shared = spark.sparkContext.broadcast(restorer)
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    chosen = (chosen if learn is None else chosen.where(learn)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(sample).withColumnRenamed(key, "id")
    rows = one_per_id(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id"), "id", "text", "label")

    def prepare(batch):
        text = restored(batch.column("text"), shared.value)
        return [text, pa.array(families(text).view(np.int64))]
    rows = Stored(append(rows, "text string, family long", prepare), "toxicity-sample")
    single = rows.read().groupBy("family", "label").agg(F.min(F.struct("id", "text"))["text"].alias("text"))
    precision = F.col("ones") / (F.col("ones") + F.col("zeros") + PRIOR)
    best = (_feature_counts(single).withColumn("precision", precision).where((F.col("ones") >= 3) & (F.col("ones") >= 4 * F.col("zeros")))
            .orderBy(F.col("precision").desc(), "feature").limit(FEATURES).collect())
    hashes = np.array([r["feature"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = ToxicityModel(restorer, hashes[order], np.array([r["precision"] for r in best])[order])
    shared_model = spark.sparkContext.broadcast(model)

    def weigh(batches):
        for batch in batches:
            found = shared_model.value.evidence(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found)], ["label", "best"])
    held = rows.read().select("text", "label").mapInArrow(weigh, "label int, best double").collect()
    rows.drop()
    if held:
        model.curve = _fit(np.array([r["best"] for r in held]), np.array([r["label"] for r in held], float))
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, "score double", lambda batch: [pa.array(shared.value.score(batch.column(text)))])


def restore_texts(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``restored``, the text with suspicious spans decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, "restored string", lambda batch: [restored(batch.column(text), shared.value.restorer)])


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score stays below ``threshold``, columns unchanged."""
    names = [f"_c{i}" for i in range(len(docs.columns))]       # so that a column called score survives
    scored = score(docs.toDF(*names), model, names[docs.columns.index("text")]).where(F.col("score") < threshold)
    return scored.drop("score").toDF(*docs.columns)


@query("op7_toxicity")
def op7_toxicity(spark, folder):
    """Every document scored; labels of one fold in four are not learned from."""
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"), learn=~in_part(2, 4))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", in_part(2, 4).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
