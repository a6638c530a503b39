"""Exact substring de-duplication by sorting suffixes deep-shallow.

Every byte covered by a ``length``-byte window that also starts anywhere else goes.

Sorting all suffixes of a corpus would move hundreds of bytes per byte of text.  Instead, each
window is filed under its *anchor*: of the ``SEED``-byte strings in the window the one with the
smallest hash (leftmost of equal ones).  Equal windows have equal anchors at equal places, so only
windows under one anchor string need comparing.  The windows of a document with the same anchor
occurrence form a run; the bytes they cover are the run's *context*.

1. Anchors are counted by seed hash; those that occur once are done.
2. A context that occurs twice as a whole is repeated as a whole, however often it occurs: copies
   are settled by counting, before anything is gathered.
3. Of the anchors with several different contexts each context is fetched once and the suffixes in
   it are sorted: multikey quicksort, eight bytes at a time, to a shallow depth; what still shares
   a prefix then goes into blind tries, which compare a suffix with one leaf only.  Suffixes in the
   same leaf are equal windows.
4. An anchor with more than ``HOT`` different contexts is not gathered.  Its contexts are cut into
   slices of ``SLICE`` windows by their distance from the anchor.  Slices that occur twice as a
   whole are settled by counting 128-bit digests; of the others, those whose core (the bytes that
   all windows of the slice share) occurs twice are taken apart, and their windows counted alike.

Cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; a repeated
row counts as a copy; rows with a null or shared doc_id are rows like others (they are numbered
first); extra columns are kept by ``without_repeats``, where characters cut in half by a removal go
as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import Stored, blocks, join_by_key, merged, mix64, powers, query, table, text_bytes
from shelfspark.llm.common import _BYTE_VALUES as BYTE_VALUES

LENGTH = 200
SEED = 40
SHALLOW = 64        # bytes sorted by multikey quicksort
HOT = 2000          # different contexts of an anchor that one task may gather
SLICE = 8           # windows counted together at such an anchor
CHUNK = 1 << 21     # bytes of contexts sorted together
_PLACE = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Runs of windows with the same anchor: document, first window start (in the document), further
    windows, distance from there to the anchor, seed hash, context hash."""
    found = []
    for i, j in blocks(offsets):
        base = int(offsets[i])
        stop = int(offsets[j])
        if j - i > 1 or stop - base <= (1 << 19):
            found.append(_anchors(data[base:stop], offsets[i:j + 1] - base, i, 0, length, seed))
        else:           # one long document: overlapping pieces; a run cut in two is two runs
            for at in range(base, max(stop - length, base) + 1, 1 << 19):
                piece = data[at:min(stop, at + (1 << 19) + length - 1)]
                found.append(_anchors(piece, np.array([0, len(piece)]), i, at - base, length, seed))
    if not found:
        found = [_nothing()]
    return tuple(np.concatenate(x) for x in zip(*found))


def _nothing():
    return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))


def _anchors(data, offsets, doc_base, shift, length, seed):
    n, width = len(data), length - seed + 1
    if n < length:
        return _nothing()
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=total[1:])
    hashes = mix64((total[seed:] - total[:-seed]) * down[:n - seed + 1])
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    place = (least & _PLACE).astype(np.int64)               # by window start
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(place)]
    start = np.flatnonzero(np.arange(length, length + len(place)) <= offsets[1:][doc])
    if not len(start):
        return _nothing()
    new = np.flatnonzero(np.append(True, place[start[1:]] != place[start[:-1]]))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    context = mix64((total[last + length] - total[first]) * down[first] ^ (last - first).astype(np.uint64))
    return (doc[first] + doc_base, first - offsets[:-1][doc[first]] + shift, last - first, place[first] - first,
            hashes[place[first]], context)


class BlindTrie:
    """Trie that keeps the depths where strings part, not the skipped bytes.

    A string goes down by the bytes at those depths alone, is compared with the one string it
    arrives at, and is hooked in where the two part.  All strings have the same length."""

    def __init__(self):
        self.root = None        # leaf: (string, [numbers]); node: [depth, {byte: child}]

    def insert(self, string: bytes, number: int) -> None:
        if self.root is None:
            self.root = (string, [number])
            return
        node = self.root
        while type(node) is list:
            child = node[1].get(string[node[0]])
            node = next(iter(node[1].values())) if child is None else child
        if node[0] == string:
            node[1].append(number)
            return
        apart = int.from_bytes(node[0]) ^ int.from_bytes(string)
        depth = len(string) - (apart.bit_length() + 7) // 8
        other = node[0][depth]
        above, node = None, self.root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][string[node[0]]]
        leaf = (string, [number])
        if type(node) is list and node[0] == depth:
            node[1][string[depth]] = leaf
            return
        branch = [depth, {other: node, string[depth]: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][string[above[0]]] = branch

    def leaves(self):
        """The leaves in the order of their strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
            else:
                yield node


def equal_windows(data: np.ndarray, group: np.ndarray, place: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Sorts the windows of ``data`` that start at ``place`` within their groups; True where another
    window of the group is equal."""
    shared = np.zeros(len(place), bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(len(data), np.uint64)
    for t in range(8):
        eight = (eight << np.uint64(8)) | padded[t:t + len(data)]
    which, segment, depth = np.arange(len(place)), group, 0
    while len(which) and depth < min(shallow, length - length % 8):
        key = eight[place[which] + depth]
        order = np.lexsort((key, segment))
        which, segment, key = which[order], segment[order], key[order]
        new = np.append(True, (segment[1:] != segment[:-1]) | (key[1:] != key[:-1]))
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        keep = np.repeat(size > 1, size)
        segment = (np.cumsum(new) - 1)[keep]
        which, depth = which[keep], depth + 8
    raw, trie, last = data.tobytes(), None, -1
    starts = place[which].tolist()
    for number, own, at in zip(which.tolist(), segment.tolist(), starts):
        if own != last:
            _mark(trie, shared)
            trie, last = BlindTrie(), own
        trie.insert(raw[at:at + length], number)
    _mark(trie, shared)
    return shared


def _mark(trie: BlindTrie | None, shared: np.ndarray) -> None:
    for _, numbers in trie.leaves() if trie else ():
        if len(numbers) > 1:
            shared[numbers] = True


def _anchor_rows(length: int, seed: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc, start, more, lead, seeds, contexts = anchors(data, offsets, length, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(more.astype(np.int32)), pa.array(lead.astype(np.int32)),
                 pa.array(seeds.view(np.int64)), pa.array(contexts.view(np.int64))], ["doc_id", "start", "more", "lead", "seed", "context"])
    return run


def _cut_contexts(length: int):
    """The bytes of the contexts asked for."""
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            flat = wanted.flatten()
            start, more = flat.field("start").to_numpy(), flat.field("more").to_numpy()
            raw = data.tobytes()
            at = offsets[row] + start
            bodies = [raw[a:b] for a, b in zip(at.tolist(), (at + more + length).tolist())]
            for k in range(0, len(bodies), 10_000):
                some = slice(k, k + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row[some])), pa.array(start[some]), flat.field("lead")[some], flat.field("seed")[some],
                     flat.field("kinds")[some], flat.field("single")[some], pa.array(bodies[some], pa.binary())],
                    ["doc_id", "start", "lead", "seed", "kinds", "single", "body"])
    return run


def _window_runs(batch: pa.RecordBatch, shared: np.ndarray, row: np.ndarray, offset: np.ndarray, length: int) -> pa.RecordBatch:
    """Byte spans covered by the shared windows of the contexts that occur once."""
    hit = shared & np.asarray(batch.column("single").to_numpy(zero_copy_only=False), bool)[row]
    row, begin = row[hit], batch.column("start").to_numpy()[row[hit]] + offset[hit]
    new = np.append(True, (row[1:] != row[:-1]) | (begin[1:] > begin[:-1] + length)) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[first])), pa.array(begin[first]), pa.array(begin[last] + length)],
                                      ["doc_id", "begin", "stop"])


def _windows(batch: pa.RecordBatch, length: int):
    """(bytes, context row, offset in the context, place in the bytes) of every window."""
    size = pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(batch.column("body").to_pylist()), np.uint8)
    count = size - length + 1
    row = np.repeat(np.arange(batch.num_rows), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return data, row, offset, (np.cumsum(size) - size)[row] + offset


def _sorted_spans(length: int):
    """Sorts the suffixes in contexts that arrive ordered by seed; a chunk ends where a seed does."""
    def settle(held: list[pa.RecordBatch]):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, row, offset, place = _windows(batch, length)
        group = np.unique(batch.column("seed").to_numpy(), return_inverse=True)[1][row]
        return _window_runs(batch, equal_windows(data, group, place, length), row, offset, length)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            seeds = batch.column("seed").to_numpy()
            cut = 0
            for end in [*(np.flatnonzero(seeds[1:] != seeds[:-1]) + 1), batch.num_rows]:
                if size >= CHUNK and (not held or held[-1].column("seed")[-1].as_py() != seeds[cut]):
                    yield settle(held)
                    held, size = [], 0
                held.append(batch.slice(cut, end - cut))
                size += held[-1].column("body").nbytes
                cut = end
        if size:
            yield settle(held)
    return run


def _slices(length: int):
    """One row per slice of a hot anchor's contexts: digests of the slice and of its core, its bytes."""
    def run(batches):
        for batch in batches:
            index, begin, whole, core, body = [], [], [], [], []
            for i, (start, lead, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "lead", "body")))):
                last = len(raw) - length
                for k in range((lead - last) // SLICE, lead // SLICE + 1):      # windows lie lead, lead - 1, ... before the anchor
                    first, final = max(0, lead - k * SLICE - SLICE + 1), min(last, lead - k * SLICE)
                    piece = raw[first:final + length]
                    inner = raw[lead - k * SLICE:lead - k * SLICE - SLICE + 1 + length]
                    tag = k.to_bytes(4, "little", signed=True)
                    index.append(i)
                    begin.append(start + first)
                    whole.append(xxhash.xxh3_128_digest(tag + (final - first).to_bytes(4, "little") + piece))
                    core.append(xxhash.xxh3_128_digest(tag + inner))
                    body.append(piece)
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array(index, pa.int64())) for c in (batch.column("doc_id"), batch.column("single"))]
                + [pa.array(begin, pa.int64()), pa.array(whole, pa.binary()), pa.array(core, pa.binary()), pa.array(body, pa.binary())],
                ["doc_id", "single", "begin", "whole", "core", "body"])
    return run


def _digests(length: int):
    """One row per window of a slice, with a 128-bit digest."""
    def run(batches):
        for batch in batches:
            data, row, offset, place = _windows(batch, length)
            raw = data.tobytes()
            digest = [xxhash.xxh3_128_digest(raw[a:a + length]) for a in place.tolist()]
            single = batch.column("single").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(batch.column("begin").to_numpy()[row] + offset),
                                              single, pa.array(digest, pa.binary())], ["doc_id", "begin", "single", "digest"])
    return run


def _counted_spans(hot: DataFrame, kind: str, length: int) -> tuple[DataFrame, list[Stored]]:
    """Spans at hot anchors, by counting slices and then windows; and the tables to drop later."""
    slices = Stored(hot.mapInArrow(_slices(length), f"doc_id {kind}, single boolean, begin long, whole binary, core binary, body binary"), "hot-slices")
    twice = Stored(slices.read().groupBy("whole").agg(F.count("*").alias("n")).where("n > 1"), "hot-whole")
    shared = Stored(slices.read().groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), "hot-cores")
    settled = (join_by_key(slices.read().where("single"), twice.read(), ["whole"], "n")
               .select("doc_id", "begin", (F.col("begin") + F.octet_length("body")).alias("stop")))
    # one slice stands for equal ones, which are settled but may hold windows of others
    equal = join_by_key(slices.read(), twice.read(), ["whole"], "n").drop("n").dropDuplicates(["whole"]).withColumn("single", F.lit(False))
    heavy = F.broadcast(twice.read().orderBy(F.col("n").desc(), "whole").limit(256).select("whole"))
    rest = slices.read().join(heavy, "whole", "left_anti").join(twice.read(), "whole", "left_anti")
    different = Stored(rest.unionByName(equal), "hot-different")
    apart = join_by_key(different.read(), shared.read(), ["core"], "n").select("doc_id", "single", "begin", "body")
    windows = Stored(apart.mapInArrow(_digests(length), f"doc_id {kind}, begin long, single boolean, digest binary"), "hot-windows")
    again = Stored(windows.read().groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "hot-digests")
    counted = (join_by_key(windows.read().where("single"), again.read(), ["digest"], "n")
               .select("doc_id", "begin", (F.col("begin") + length).alias("stop")))
    return settled.unionAll(counted), [slices, twice, shared, different, windows, again]


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(key, begin, stop): byte spans of repeated windows, overlapping ones not yet united.  ``key``
    tells the rows apart (see ``_told_apart``)."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    filed = Stored(docs.mapInArrow(_anchor_rows(length, seed), f"doc_id {kind}, start long, more int, lead int, seed long, context long"), "anchors")
    often = Stored(filed.read().groupBy("seed").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
                   .where("n > 1").select("seed", (F.col("low") != F.col("high")).alias("mixed")), "repeated-seeds")
    again = Stored(filed.read().join(often.read(), "seed"), "repeated-anchors")     # a plain join, so that a hot seed can be split
    filed.drop()
    often.drop()
    kinds = Stored(again.read().groupBy("seed", "context", "mixed")
                   .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "more", "lead")).alias("one")), "contexts")
    whole = (join_by_key(again.read(), kinds.read().where("n > 1").select("seed", "context", "n"), ["seed", "context"], "n")
             .select("doc_id", F.col("start").alias("begin"), (F.col("start") + F.col("more") + length).alias("stop")))
    per = kinds.read().where("mixed").groupBy("seed").agg(F.count("*").alias("kinds"))
    wanted = (kinds.read().where("mixed").join(per, "seed")
              .select("one.doc_id", F.struct("one.start", "one.more", "one.lead", "seed", "kinds", (F.col("n") == 1).alias("single")).alias("wanted"))
              .groupBy("doc_id").agg(F.collect_list("wanted").alias("wanted")))
    bodies = Stored(docs.join(wanted, "doc_id")
                    .mapInArrow(_cut_contexts(length), f"doc_id {kind}, start long, lead int, seed long, kinds long, single boolean, body binary"), "context-bytes")
    spans = f"doc_id {kind}, begin long, stop long"
    ordered = (bodies.read().where(F.col("kinds") <= hot).repartition("seed").sortWithinPartitions("seed").mapInArrow(_sorted_spans(length), spans))
    counted, held = _counted_spans(bodies.read().where(F.col("kinds") > hot), kind, length)
    found = Stored(whole.unionAll(ordered).unionAll(counted), "spans")
    for old in (again, kinds, bodies, *held):
        old.drop()
    return found.read().withColumnRenamed("doc_id", key)


def _removed(text: str, keep_text: bool):
    """Removal counts and what remains, per row with its spans."""
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            raw, spans = data.tobytes(), batch.column("_spans")
            size, removed, count, digest, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                own = raw[offsets[i]:offsets[i + 1]]
                begin, stop = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if spans[i].is_valid:
                    flat = spans[i].values
                    begin, stop = merged(flat.field("begin").to_numpy(), flat.field("stop").to_numpy())
                size.append(len(own))
                removed.append(int((stop - begin).sum()))
                count.append(len(begin))
                edges = [0, *np.stack([begin, stop], 1).ravel().tolist(), len(own)]
                rest = b"".join(own[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2))
                if keep_text:
                    kept.append(None if not batch.column(text)[i].is_valid else _text(own, edges))
                else:
                    digest.append(hashlib.sha256(rest).hexdigest())
            names = [name for name in batch.schema.names if name != "_spans"]
            if keep_text:
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if name == text else batch.column(name) for name in names], names)
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(removed), pa.array(count), pa.array(digest)],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def _text(own: bytes, edges: list[int]) -> str:
    """The kept pieces as text, without the parts of characters that a removal cut."""
    return "".join(own[edges[k]:edges[k + 1]].decode("utf-8", "ignore") for k in range(0, len(edges), 2))


def _told_apart(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``_row``, which no two rows share: the key, or, where keys are null or repeat, a
    number given to the rows as they are stored."""
    counted = docs.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
    if counted.isEmpty():
        return docs.withColumn("_row", F.col(key))
    return Stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered").read()


def _with_spans(docs: DataFrame, key: str, **options) -> DataFrame:
    docs = _told_apart(docs, key)
    spans = repeated_spans(docs, key="_row", **options).groupBy("_row").agg(F.collect_list(F.struct("begin", "stop")).alias("_spans"))
    return docs.join(spans, "_row", "left").drop("_row")


def removal_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs, "doc_id", **options).mapInArrow(
        _removed("text", False), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; other rows and columns unchanged."""
    return _with_spans(docs, key, text=text, **options).mapInArrow(_removed(text, True), docs.schema)


@query("op4_suffix_dedup", f"""with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
h as (select doc_id, hex(b) as h, octet_length(b) as n from d),
w as (select doc_id, i, md5(h[2 * i + 1:2 * i + {2 * LENGTH}]) as win from (select doc_id, h, unnest(range(0, n - {LENGTH - 1})) as i from h where n >= {LENGTH})),
s as (select doc_id, i from w qualify count(*) over (partition by win) > 1),
g as (select doc_id, i, case when lag(i) over (partition by doc_id order by i) >= i - {LENGTH} then 0 else 1 end as new from s),
k as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from g),
x as (select doc_id, run, min(i) as b, max(i) + {LENGTH} as e from k group by 1, 2),
p as (select doc_id, b, e, lag(e, 1, 0) over (partition by doc_id order by b) as prev from x),
t as (select doc_id, sum(e - b) as n_removed, count(*) as n_spans, string_agg(h[2 * prev + 1:2 * b], '' order by b) as head, max(e) as last
  from p join h using (doc_id) group by 1)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when last is null then h else coalesce(head, '') || h[2 * last + 1:] end)) as kept_sha256
from h left join t using (doc_id)""")
def op4_suffix_dedup(spark, folder):
    """Repeated 200-byte windows over all documents."""
    return removal_report(table(spark, folder, "documents"))
