"""Token counts through a digest cache.

The cache is a table (tokenizer digest, content digest, count) in a folder.  Content is what the
tokenizer's own normaliser makes of a text, with special-token strings kept apart; its digest and
the digest of the tokenizer (file and library version) are joined to the stored counts.  Only
distinct contents that the cache lacks are encoded, each once, and their counts are appended.

Encoding: where a text has plain Latin letters and signs only, it is split into the tokenizer's
pre-tokens, each distinct one is encoded by the library once per worker and remembered (a full
memory is emptied, which costs time only); other texts go through the library whole.  Both ways
give the library's count of the text.

Cases: null counts as empty; empty texts have 0 tokens; equal contents share one entry; rows that
share a doc_id are counted by their own texts; a cache folder that does not exist yet is empty.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import Stored, join_by_key, query, release, scratch, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
SLOTS = 1 << 20         # slots of row keys by which texts to be encoded are told
MEMORY = 250_000        # pre-tokens that a worker remembers
OTHER = regex.compile(r"[^\x00-\x1b\x20-\u024f\u2010-\u2027\u20ac]")     # beyond Latin letters and signs
CACHE = "tokenizer string, content binary, n_tokens long"


class Counter:
    """A tokenizer file taken apart: special strings, normaliser, and the rest without either."""

    def __init__(self, source: str):
        self.source = source
        self.version = hashlib.sha256(f"{tokenizers.__version__}\n{source}".encode()).hexdigest()
        self._ready = False

    def __getstate__(self):
        return {"source": self.source, "version": self.version}

    def __setstate__(self, state):
        self.__dict__.update(state, _ready=False)

    def ready(self) -> Counter:
        if not self._ready:
            parts = json.loads(self.source)
            special = [t["content"] for t in parts["added_tokens"]]
            self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
            self.plain_special = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in parts["added_tokens"])
            self.whole = tokenizers.Tokenizer.from_str(self.source)
            self.whole.no_truncation()
            self.whole.no_padding()
            self.normalizer = self.whole.normalizer
            bare = tokenizers.Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "added_tokens": [], "post_processor": None,
                                                                     "truncation": None, "padding": None}))
            bare.no_truncation()
            bare.no_padding()
            self.bare, self.pattern, self.usual = bare, _word_pattern(parts), _usual_steps(parts)
            if self.plain_special:
                self.whole = None       # its vocabulary is not needed twice
            self.memory: dict[str, int] = {}
            self._ready = True
        return self

    def content(self, text: str) -> list[tuple[bool, str]]:
        """Normalised segments between special strings, and whether each is plain; the bare text
        where specials need context."""
        if not self.plain_special:
            return [(False, text)]
        return [self.normal(s) for s in (self.special.split(text) if self.special else [text])]

    def normal(self, segment: str) -> tuple[bool, str]:
        """What the tokenizer makes of a segment.  For plain text under the usual steps (NFC, white
        space, lower case) Python does the same, but for blanks at the ends, which no token holds."""
        if self.usual and not OTHER.search(segment):
            return True, " ".join(unicodedata.normalize("NFC", segment).lower().split())
        return False, self.normalizer.normalize_str(segment) if self.normalizer and segment else segment

    @staticmethod
    def digest(content: list[tuple[bool, str]]) -> bytes:
        made = hashlib.blake2b(digest_size=16)
        for _, segment in content:
            raw = segment.encode("utf-8", "surrogatepass")
            made.update(len(raw).to_bytes(8, "little") + raw)
        return made.digest()

    def counts(self, contents: list[list[tuple[bool, str]]]) -> list[int]:
        """Tokens of each content, special strings one each."""
        if not self.plain_special:
            return [len(e) for e in self.whole.encode_batch_fast([c[0][1] for c in contents], add_special_tokens=False)]
        out = [len(c) - 1 for c in contents]
        if len(self.memory) > MEMORY:
            self.memory.clear()
        words: list[tuple[int, list[str]]] = []
        for i, parts in enumerate(contents):
            for plain, part in parts:
                if plain and self.pattern is not None:
                    words.append((i, self.pattern.findall(part)))
                elif part:
                    out[i] += len(self.bare.encode(part, add_special_tokens=False))
        missing = sorted({w for _, found in words for w in found} - self.memory.keys())
        for k in range(0, len(missing), 5000):
            some = missing[k:k + 5000]
            self.memory.update(zip(some, (len(e) for e in self.bare.encode_batch_fast(some, add_special_tokens=False))))
        for i, found in words:
            out[i] += sum(map(self.memory.__getitem__, found))
        return out


def _usual_steps(parts: dict) -> bool:
    """The normaliser composes, turns runs of white space into one blank, and lowers the case; the
    splitter drops blanks."""
    steps = (parts.get("normalizer") or {}).get("normalizers") or []
    return (_word_pattern(parts) is not None and [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1].get("pattern") == {"Regex": "\\s+"} and steps[1].get("content") == " ")


def _word_pattern(parts: dict):
    """The pre-tokens as a pattern, where the file splits by one pattern and keeps only matches."""
    steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") \
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex"):
        return regex.compile(steps[0]["pattern"]["Regex"])
    return None


def _digests(counter):
    """Key, size and content digest of every text."""
    def run(batches):
        for batch in batches:
            one = counter.value.ready()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                                              pa.array([one.digest(one.content(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "content"])
    return run


def _packed(chosen):
    """Texts of the rows whose slot is chosen, compressed for the shuffle."""
    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch = batch.filter(pa.array(chosen.value[batch.column("slot").to_numpy()]))
            packed = [packer.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])
    return run


def _counted(counter):
    """Content digest and token count of packed texts."""
    def run(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            one = counter.value.ready()
            packed = batch.column("packed").to_pylist()
            for k in range(0, len(packed), 200):
                contents = [one.content(unpacker.decompress(p).decode()) for p in packed[k:k + 200]]
                yield pa.RecordBatch.from_arrays([pa.array([one.digest(c) for c in contents], pa.binary()), pa.array(one.counts(contents), pa.int64())],
                                                 ["content", "n_tokens"])
        if counter.value._ready:
            counter.value.memory.clear()
        release()
    return run


def _cache(spark, path: str, version: str) -> DataFrame:
    """Counts stored for this tokenizer."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        stored = spark.read.schema(CACHE).parquet(path)
    else:
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).select("content", "n_tokens")


def count_tokens(docs: DataFrame, cache: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs`` (doc_id, text); ``cache`` is a folder all
    executors reach, and grows by what it lacked."""
    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        one = Counter(file.read())
    counter = spark.sparkContext.broadcast(one)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = Stored(docs.mapInArrow(_digests(counter), f"doc_id {kind}, n_bytes long, content binary"), "digests")
    contents = Stored(keyed.read().groupBy("content").agg(F.min("doc_id").alias("one"), F.count(F.lit(1)).alias("copies")), "contents")
    missing = Stored(contents.read().join(_cache(spark, cache, one.version), "content", "left_anti").select("one").distinct(), "missing")
    # Texts move to be encoded only where their slot holds a missing content: a table of a fixed
    # size tells.  The join is the same at every size, so that what it moves follows the input.
    slot = F.xxhash64("doc_id").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")
    chosen = np.zeros(SLOTS, bool)
    chosen[missing.read().select(F.col("one").alias("doc_id")).select(slot).distinct().toArrow().column("slot").to_numpy()] = True
    packed = docs.select("doc_id", "text", slot).mapInArrow(_packed(spark.sparkContext.broadcast(chosen)), f"doc_id {kind}, packed binary")
    asked = missing.read().hint("merge")
    encoded = packed.join(asked, packed["doc_id"].eqNullSafe(asked["one"])).select("packed")
    (encoded.mapInArrow(_counted(counter), "content binary, n_tokens long").dropDuplicates(["content"])
     .join(_cache(spark, cache, one.version), "content", "left_anti")
     .select(F.lit(one.version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache))
    known = _cache(spark, cache, one.version).dropDuplicates(["content"])
    counts = Stored(contents.read().select("content", "copies").join(known, "content"), "counts")
    result = Stored(join_by_key(keyed.read(), counts.read(), ["content"], "copies").select("doc_id", "n_bytes", "n_tokens"), "token-counts")
    for stored in (keyed, contents, missing, counts):
        stored.drop()
    return result.read()


@query("op2_token_counts")
def op2_token_counts(spark, folder):
    """Every document counted, beginning with an empty cache, so that the work follows the input."""
    counted = count_tokens(table(spark, folder, "documents"), scratch(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
