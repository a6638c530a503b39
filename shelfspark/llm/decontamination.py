"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

Words are runs of letters, digits and non-ASCII characters, ASCII lower-cased.  Every run of
``n`` words of a benchmark item is a window (an item of fewer words is one window).  The windows
are a broadcast set of 64-bit hashes; a scan rolls the same hash over each document's words, looks
the hashes up and confirms each hit on the words themselves.

The benchmark is broadcast in blocks of at most ``block_bytes`` of text, so what is broadcast has
a fixed bound; each further block costs one more scan, behind the others, and the hits stay in the
document's row.

Cases: null or wordless text has no words and no hits; items without words have no windows;
repeated documents and rows with a null key are each judged, however many blocks the benchmark has;
extra columns stay untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import Stored, Words, blocks, merged, query, runs, table, text_bytes

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
KIND = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
FILTER_BITS = 20
SCANS = 4       # scans behind one another, each in a Python worker of its own, before rows are stored


class NgramSet:
    """Windows of benchmark items, by length: hashes for the scan, words for the confirmation."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.n = n
        self.items: dict[bytes, list[str]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            words = WORD.findall((text or "").encode().lower())
            if not words:
                continue
            width = min(n, len(words))
            for i in range(len(words) - width + 1):
                owners = self.items.setdefault(b" ".join(words[i:i + width]), [])
                if item not in owners:
                    owners.append(item)
            data = b" ".join(words)
            found = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), KIND)
            hashes.setdefault(width, []).append(runs(found.hash, width))
        self.lengths = []
        for width, parts in sorted(hashes.items()):
            values = np.unique(np.concatenate(parts))
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[values >> np.uint64(64 - FILTER_BITS)] = True
            self.lengths.append((width, values, seen))

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """(words, hit mask over words, per document the items found)"""
        words = Words(data, offsets, KIND)
        count = len(words.start)
        depth = np.zeros(count + 1, np.int64)
        found: dict[int, set[str]] = {}
        for width, values, seen in self.lengths:
            hashes = runs(words.hash, width)
            maybe = np.flatnonzero(seen[hashes >> np.uint64(64 - FILTER_BITS)])
            maybe = maybe[words.doc[maybe] == words.doc[maybe + width - 1]]
            place = np.minimum(np.searchsorted(values, hashes[maybe]), len(values) - 1)
            for i in maybe[values[place] == hashes[maybe]]:
                window = WORD.findall(data[words.start[i]:words.end[i + width - 1]].tobytes().lower())
                owners = self.items.get(b" ".join(window))
                if owners:
                    depth[i] += 1
                    depth[i + width] -= 1
                    found.setdefault(int(words.doc[i]), set()).update(owners)
        return words, np.cumsum(depth[:-1]) > 0, found


def _spans(words: Words, hit: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one word of each maximal run of hit words of one document."""
    flags = np.zeros(words.at[doc + 1] - words.at[doc] + 2, np.int8)
    flags[1:-1] = hit[words.at[doc]:words.at[doc + 1]]
    step = np.diff(flags)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


SCANNED = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
                                                     T.StructField("begin", T.LongType()), T.StructField("stop", T.LongType())])), False),
    T.StructField("items", T.ArrayType(T.StringType()), False)])


def _scan(ngrams, text: str, begins: bool, ends: bool):
    """Adds the columns of SCANNED, or what a further block finds to them; the last scan drops the text."""
    added = [field.name for field in SCANNED.fields]

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            n_words, spans, items = [], [], []
            for i, j in blocks(offsets):
                own = offsets[i:j + 1] - offsets[i]
                words, hit, found = ngrams.value.scan(data[offsets[i]:offsets[j]], own)
                n_words += np.diff(words.at).tolist()
                for doc in range(j - i):
                    rows = []
                    if doc in found:
                        first, last = _spans(words, hit, doc)
                        at, base = words.at[doc], own[doc]
                        rows = [{"first": int(a), "last": int(b), "begin": int(words.start[at + a] - base),
                                 "stop": int(words.end[at + b - 1] - base)} for a, b in zip(first, last)]
                    spans.append(rows)
                    items.append(sorted(found.get(doc, ())))
            if not begins:
                spans = [_united(a + b) if a and b else a or b for a, b in zip(batch.column("spans").to_pylist(), spans)]
                items = [sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), items)]
            extra = [pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
            columns = [(name, batch.column(name)) for name in batch.schema.names if name not in added and not (ends and name == text)]
            yield pa.RecordBatch.from_arrays([c for _, c in columns] + extra, [name for name, _ in columns] + added)
    return scan


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64())]))


def _item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The benchmark in pieces of at most ``block_bytes`` (or one longer item), by a streaming read."""
    held, size = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        weight = len(row[1] or "")
        if held and size + weight > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += weight
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", n: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """Per row of ``docs``: key, ``n_words``, hit ``spans`` (first and last-plus-one word; begin and
    stop byte) and the ``items`` whose windows occur."""
    spark, stored = docs.sparkSession, None
    docs = docs.select(key, text)
    kept = list(docs.schema.fields)
    held_blocks = _item_blocks(benchmark, item, item_text, block_bytes)
    held, done = next(held_blocks), 0
    while held is not None:
        following = next(held_blocks, None)
        if done and done % SCANS == 0:
            before, stored = stored, Stored(docs, "scanned")
            docs = stored.read()
            if before:
                before.drop()
        ngrams = spark.sparkContext.broadcast(NgramSet(held, n))
        fields = [docs.schema[key]] if following is None else kept
        docs = docs.mapInArrow(_scan(ngrams, text, done == 0, following is None), T.StructType([*fields, *SCANNED.fields]))
        held, done = following, done + 1
    return docs


def _united(spans: list) -> list:
    """Spans of several scans of a document, united."""
    first, last = merged(np.array([x["first"] for x in spans], np.int64), np.array([x["last"] for x in spans], np.int64))
    begin = {x["first"]: x["begin"] for x in spans}
    stop = {x["last"]: x["stop"] for x in spans}
    return [{"first": int(a), "last": int(b), "begin": begin[int(a)], "stop": stop[int(b)]} for a, b in zip(first, last)]


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                         n: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """Rows of ``docs`` in which no benchmark window occurs, columns unchanged: one pass of the scan
    behind the other per benchmark block, without a shuffle."""
    def clean(ngrams):
        def run(batches):
            for batch in batches:
                data, offsets = text_bytes(batch.column(text))
                keep = np.ones(batch.num_rows, bool)
                for i, j in blocks(offsets):
                    found = ngrams.value.scan(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])[2]
                    keep[[i + doc for doc in found]] = False
                yield batch.filter(pa.array(keep))
        return run
    stored = None
    for done, held in enumerate(_item_blocks(benchmark, item, item_text, block_bytes)):
        if done and done % SCANS == 0:      # no more scans than that are chained in a task
            before, stored = stored, Stored(docs, "scanned")
            docs = stored.read()
            if before:
                before.drop()
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(NgramSet(held, n))), docs.schema)
    return docs


def without_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the hit words cut out of ``text`` (from the first byte of a run of hit words to
    its last); other rows and columns unchanged.  ``key`` must be unique."""
    found = contamination(docs, benchmark, key=key, text=text, **options).where(F.size("items") > 0)
    found = found.select(F.col(key).alias("_hit"), "spans")
    joined = docs.join(found, docs[key] == F.col("_hit"), "left")
    data = F.encode(F.col(text), "utf-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.stop"))
    stops = F.concat(F.col("spans.begin"), F.array(F.octet_length(text).cast("long")))
    kept = F.zip_with(ends, stops, lambda a, b: F.decode(F.substring(data, a.cast("int") + 1, (b - a).cast("int")), "utf-8"))
    cut = F.when(F.col("spans").isNull(), F.col(text)).otherwise(F.array_join(kept, ""))
    return joined.select(*[cut.alias(c) if c == text else docs[c] for c in docs.columns])


ITEMS_SQL = r"""
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
bn as (select item_id, words, least(10, len(words)) as width from b where len(words) > 0),
bw as (select distinct item_id, width, array_to_string(words[i:i + width - 1], ' ') as win
  from (select item_id, words, width, unnest(range(1, len(words) - width + 2)) as i from bn)),
widths as (select distinct width from bw),
dw as (select doc_id, i, width, array_to_string(words[i:i + width - 1], ' ') as win
  from (select doc_id, words, width, unnest(range(1, len(words) - width + 2)) as i from w, widths where len(words) >= width)),
hit as (select doc_id, i, dw.width, item_id from dw join bw on dw.width = bw.width and dw.win = bw.win),
hw as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + width)) as p from hit) group by 1),
hi as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from hit group by 1)"""


@query("op8_decontamination", f"""with {ITEMS_SQL}
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hw using (doc_id) left join hi using (doc_id)""")
def op8_decontamination(spark, folder):
    """Every document against every benchmark item, windows of ten words."""
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
