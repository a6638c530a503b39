"""Alignment of two tokenizers by external spill counting.

Each text, with a space in front, is encoded by a byte-level BPE file (A) and a SentencePiece model
(B).  Offsets where tokens of both end cut the tokens into groups; an A and a B token whose byte
ranges overlap are linked.  A pair of ids counts in how many documents it is linked, and per
document the links are told that are the best of their A id, and the counts of all links.

Method.  Tasks encode documents and file pair-document records, sorted by pair and radix-partitioned
by A id, as Zstandard runs in the shared folder; beside them, per run, the number of documents of
each pair.  Those counts are merged: per radix, blocks of the runs arrive in the order of their
first pair and a heap of open blocks gives out all pairs below the next block's first one, summed;
``FAN`` runs go into a merge, and merges follow each other until one run per radix is left.  It
lists pairs in the order of A ids, so the highest count of an A id is known from its stretch.  The
counts then stream past the records of each radix, run by run, and what a run's documents gain goes
back to the run, where sums and documents meet.

Bounds: a run holds the documents of Arrow batches of ``RUN`` bytes of text in all (or one longer
document); a block has at most ``BLOCK`` pairs; an A id has at most as many pairs as B has ids, so a radix cannot outgrow the
vocabularies.  A frequent pair is one entry per run, not one per document.

Encoding: neither tokenizer joins across a white-space run that begins with a blank or line end and
follows another character, so texts are cut there, and each distinct stretch is encoded and aligned
once per worker (the memory is emptied when full, which costs time only).  Other files, where that
is not certain, are encoded text by text.

Cases: null and empty texts, and texts whose joined A or B bytes differ from the text with its
space, have no tokens: zeros, and an empty digest; each row is a document of its own, whatever its
id (null and repeated ids stay as they are); equal highest counts are all best; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfspark.llm.common import Stored, query, release, table

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
RUN = 8 << 20           # bytes of text of a run
RADIX = 256
BLOCK = 1 << 16         # pairs of a block of counts
FAN = 64                # runs merged at once
SIDE = 64               # runs of a radix that a task takes its counts past
MEMORY = 250_000        # stretches a worker remembers
STRETCH = re.compile(r"\s+\S*(?:(?![ \n])\s+\S*)*")
FACTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for
    themselves, the others for the letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and what is known of the stretches of text met so far."""

    def __init__(self, file_a: str, file_b: str):
        with open(file_a, encoding="utf-8") as file:
            self.source_a = file.read()
        with open(file_b, "rb") as file:
            self.source_b = file.read()
        self._ready = False

    def __getstate__(self):
        return {"source_a": self.source_a, "source_b": self.source_b}

    def __setstate__(self, state):
        self.__dict__.update(state, _ready=False)

    def ready(self) -> Aligner:
        if not self._ready:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import tokenizers
            parts = json.loads(self.source_a)
            self.a = tokenizers.Tokenizer.from_str(self.source_a)
            self.a.encode_special_tokens = True
            self.a.no_truncation()
            self.a.no_padding()
            self.b = sentencepiece.SentencePieceProcessor(model_proto=self.source_b)
            letters = _byte_letters()
            self.bytes_a = {i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
                            for token, i in self.a.get_vocab(with_added_tokens=False).items()}
            pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
            self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode()
                            for i, p in enumerate(pieces)]
            splitter = parts.get("pre_tokenizer") or {}
            self.cuts = (parts.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex")
                         and not splitter.get("add_prefix_space")
                         and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces))
            self.mark = self.b.piece_to_id("▁")
            most = max(max(self.bytes_a) + 1, len(pieces))
            self.size_a, self.size_b = np.zeros(most, np.int64), np.array([len(x) for x in self.bytes_b], np.int64)
            for i, raw in self.bytes_a.items():
                self.size_a[i] = len(raw)
            self.texts = [[b"%d%s" % (i, mark) for i in range(most)] for mark in (b",", b"|", b";")]
            self.forget()
            self._ready = True
        return self

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        # n_a, n_b, n_groups, n_links, and whether its bytes differ, of each stretch; its links
        self.facts: list[np.ndarray] = [np.zeros((0, 5), np.int64)]
        self.links: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.held = 0

    def stretches(self, text: str) -> list[str]:
        """The text with its leading space, cut where both tokenizers cut."""
        if not self.cuts:
            return [" " + text]
        found = STRETCH.findall(" " + text)
        if len(found) > 1 and found[-1].isspace():
            found[-2:] = [found[-2] + found[-1]]
        return found

    def _encoded_b(self, stretches: list[str]) -> list[list[int]]:
        """B's ids of each stretch; B puts a space in front of what it is given."""
        out = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        for i, s in enumerate(stretches):
            if s[0] != " ":
                out[i] = out[i][1:] if out[i][:1] == [self.mark] else [self.b.unk_id()]
        return out

    def learn(self, new: list[str]) -> None:
        """Encodes and aligns stretches that are not known."""
        for i in range(0, len(new), 8192):
            some = new[i:i + 8192]
            raws = [s.encode("utf-8", "replace") for s in some]
            self.number.update(zip(some, range(len(self.number), len(self.number) + len(some))))
            self.held += sum(map(len, raws))
            a = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            b = self._encoded_b(some)
            good = np.ones(len(some), bool)
            for ids, table_ in ((a, self.bytes_a), (b, self.bytes_b)):
                if b"".join([table_[t] for x in ids for t in x]) != b"".join(raws):
                    good &= np.array([b"".join([table_[t] for t in x]) == raw for x, raw in zip(ids, raws)])
            if not good.all():
                a, b = ([x if ok else [] for x, ok in zip(ids, good)] for ids in (a, b))
            self._align(a, b, good)

    def _align(self, a: list[list[int]], b: list[list[int]], good: np.ndarray) -> None:
        """Both tokenizations of many stretches at once, as byte offsets along all of them; where a
        stretch ends both end, so nothing reaches across."""
        count_a, count_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        flat_a, flat_b = (np.array([t for x in ids for t in x], np.int64) for ids in (a, b))
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        # between two neighbouring ends of any kind one A and one B token overlap: that is a link
        ends = np.union1d(end_a, end_b)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        self.links.append(flat_a[link_a] << 32 | flat_b[link_b])
        owner_a, owner_b = np.repeat(np.arange(len(a)), count_a), np.repeat(np.arange(len(b)), count_b)
        links = np.bincount(owner_a[link_a], minlength=len(a))
        groups = np.bincount(owner_a[np.searchsorted(end_a, cuts)], minlength=len(a))
        self.facts.append(np.stack([count_a, count_b, groups, links, ~good], 1).astype(np.int64))
        # texts of the groups: every id with what follows it, A ids of a group before its B ids
        group = np.concatenate([np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)])
        side = np.repeat([0, 1], [len(end_a), len(end_b)])
        order = np.lexsort((side, group))
        last = np.ones(len(order), bool)
        last[:-1] = (group[order][1:] != group[order][:-1]) | (side[order][1:] != side[order][:-1])
        follow = np.where(last, side[order] + 1, 0)
        texts = [self.texts[f][t] for f, t in zip(follow.tolist(), np.concatenate([flat_a, flat_b])[order].tolist())]
        at = np.concatenate([[0], np.cumsum(count_a + count_b)]).tolist()
        self.groups += [b"".join(texts[i:j])[:-1] for i, j in zip(at, at[1:])]


# --- blobs ---------------------------------------------------------------------------------------

def _small(x: np.ndarray) -> np.ndarray:
    """The values in the narrowest unsigned type that holds them."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers as one Zstandard frame."""
    small = [_small(x) for x in arrays]
    head = np.array([len(small), *itemised(small)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in small))


def itemised(arrays):
    for x in arrays:
        yield x.dtype.itemsize
        yield len(x)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    shape = np.frombuffer(raw, np.int64, 2 * n, 8).tolist()
    out, at = [], 8 + 16 * n
    for width, length in zip(shape[::2], shape[1::2]):
        out.append(np.frombuffer(raw, f"u{width}", length, at).astype(np.int64))
        at += width * length
    return out


def pack_pairs(pairs: np.ndarray, *others: np.ndarray) -> bytes:
    """Sorted pair codes, written as gaps between A ids and as B ids, with other arrays."""
    a = pairs >> 32
    return pack(np.diff(a, prepend=0), pairs & 0xFFFFFFFF, *others)


def unpack_pairs(blob: bytes) -> list[np.ndarray]:
    a, b, *others = unpack(blob)
    return [np.cumsum(a) << 32 | b, *others]


def _stretched(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each stretch, one stretch behind the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


# --- runs ----------------------------------------------------------------------------------------

RUNS = "kind string, run string, radix int, part long, first long, blob binary"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], [f.split()[0] for f in RUNS.split(", ")])


def _filed(shared, id_type, run_bytes: int, block: int):
    """Runs of the documents of a task: facts, records and counts."""
    def run_of(one: Aligner, ids: list, docs: list[np.ndarray | None], digests: list[str]):
        facts, flat = np.concatenate(one.facts), np.concatenate(one.links)
        one.facts, one.links = [facts], [flat]
        sizes = facts[:, 3]
        starts = np.cumsum(sizes) - sizes
        lengths = np.array([0 if d is None else len(d) for d in docs], np.int64)
        doc = np.repeat(np.arange(len(docs)), lengths)
        stretch = np.concatenate([d for d in docs if d is not None] or [np.zeros(0, np.int64)]).astype(np.int64)
        sums = np.zeros((len(docs), 4), np.int64)
        for k in range(4):
            sums[:, k] = np.bincount(doc, weights=facts[stretch, k], minlength=len(docs)).astype(np.int64) if len(doc) else 0
        name = uuid.uuid4().hex
        sink = pa.BufferOutputStream()
        told = pa.record_batch([pa.array(ids, id_type), *[pa.array(sums[:, k]) for k in range(4)], pa.array(digests, pa.string())],
                               ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        with pa.ipc.new_stream(sink, told.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(told)
        found = [("facts", name, -1, 0, 0, sink.getvalue().to_pybytes())]
        # stretches of a document, each once with its times, then their pairs
        key, times = np.unique(doc * max(len(sizes), 1) + stretch, return_counts=True)
        doc, stretch = key // max(len(sizes), 1), key % max(len(sizes), 1)
        at = _stretched(starts[stretch], sizes[stretch])
        codes, rank = np.unique(flat, return_inverse=True)
        key = rank.reshape(-1)[at] * len(docs) + np.repeat(doc, sizes[stretch])
        weight = np.repeat(times, sizes[stretch])
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        weight = np.add.reduceat(weight, first) if len(first) else weight
        key = key[first]
        rank, doc = key // max(len(docs), 1), key % max(len(docs), 1)
        used, begin, n = np.unique(rank, return_index=True, return_counts=True)
        pairs = codes[used]
        radix = (pairs >> 32) % RADIX
        for r in np.unique(radix).tolist():
            mine = np.flatnonzero(radix == r)
            rows = _stretched(begin[mine], n[mine])
            found.append(("records", name, r, 0, 0, pack_pairs(pairs[mine], n[mine], doc[rows], weight[rows])))
            for part, k in enumerate(range(0, len(mine), block)):
                some = mine[k:k + block]
                found.append(("counts", name, r, part, int(pairs[some[0]]), pack_pairs(pairs[some], n[some])))
        return _rows(found)

    def run(batches):
        one, ids, docs, digests, size = shared.value.ready(), [], [], [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            split = [one.stretches(text) if text else [] for text in texts]
            new = {s for stretches in split for s in stretches if s not in one.number}
            if new:
                one.learn(sorted(new))
            facts = np.concatenate(one.facts)
            one.facts = [facts]
            for doc_id, text, stretches in zip(batch.column("doc_id").to_pylist(), texts, split):
                ids.append(doc_id)
                numbers = [one.number[s] for s in stretches]
                if not numbers or facts[numbers, 4].any():
                    docs.append(None)
                    digests.append("")
                else:
                    docs.append(np.array(numbers, np.int32))
                    digests.append(hashlib.sha256(b";".join([one.groups[i] for i in numbers])).hexdigest())
                size += len(text or "")
            del texts, split, new
            if size >= run_bytes or len(ids) >= BLOCK:
                yield run_of(one, ids, docs, digests)
                ids, docs, digests, size = [], [], [], 0
                if len(one.number) > MEMORY or one.held > run_bytes:
                    one.forget()
                release()
        if ids:
            yield run_of(one, ids, docs, digests)
        one.forget()
        release()
    return run


# --- merging -------------------------------------------------------------------------------------

class Merge:
    """k-way merge of sorted blocks that arrive in the order of their first pair."""

    def __init__(self, waiting: int = 8 * BLOCK):
        self.limit = waiting
        self.open: list[tuple[int, int, np.ndarray, np.ndarray]] = []     # heap by first pair left
        self.seen = self.waiting = 0

    def add(self, pairs: np.ndarray, counts: np.ndarray):
        """Takes a block; gives (pairs, counts) that no later block can change, or None."""
        done = self.below(int(pairs[0])) if self.waiting > self.limit else None
        heapq.heappush(self.open, (int(pairs[0]), self.seen, pairs, counts))
        self.seen += 1
        self.waiting += len(pairs)
        return done

    def below(self, bound: int | None):
        taken = []
        while self.open and (bound is None or self.open[0][0] < bound):
            _, number, pairs, counts = heapq.heappop(self.open)
            cut = len(pairs) if bound is None else int(np.searchsorted(pairs, bound))
            taken.append((pairs[:cut], counts[:cut]))
            if cut < len(pairs):
                heapq.heappush(self.open, (int(pairs[cut]), number, pairs[cut:], counts[cut:]))
        if not taken:
            return None
        pairs, counts = (np.concatenate(x) for x in zip(*taken))
        self.waiting -= len(pairs)
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        return pairs[first], np.add.reduceat(counts, first)


def _merged(block: int):
    """Merges rows sorted by (radix, run, first), where ``run`` names the merge that a block goes into."""
    return lambda batches: _merged_blocks(batches, block)


def _merged_blocks(batches, block: int):
    at, merge, part = None, Merge(), 0

    def out(done):
        nonlocal part
        rows = []
        for k in range(0, len(done[0]), block):
            pairs, counts = done[0][k:k + block], done[1][k:k + block]
            rows.append(("counts", at[1], at[0], part, int(pairs[0]), pack_pairs(pairs, counts)))
            part += 1
        return _rows(rows)

    for batch in batches:
        for radix, name, blob in zip(batch.column("radix").to_pylist(), batch.column("run").to_pylist(), batch.column("blob")):
            if (radix, name) != at:
                done = merge.below(None)
                if done:
                    yield out(done)
                at, merge, part = (radix, name), Merge(8 * block), 0
            done = merge.add(*unpack_pairs(blob.as_py()))
            if done:
                yield out(done)
    done = merge.below(None)
    if done:
        yield out(done)
    release()


def _past(batches):
    """Rows sorted by (radix, slot, kind, part): the counts of a radix, then records of runs; gives
    what the documents of each run gain."""
    at, pairs, counts, best = None, [], [], None
    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in ("radix", "slot", "kind", "run")]
        for radix, slot, kind, name, blob in zip(*columns, batch.column("blob")):
            if (radix, slot) != at:
                at, pairs, counts, best = (radix, slot), [], [], None
            if kind == "counts":
                some = unpack_pairs(blob.as_py())
                pairs.append(some[0])
                counts.append(some[1])
                continue
            if best is None:
                pairs, counts = [np.concatenate(pairs)], [np.concatenate(counts)]
                side = np.flatnonzero(np.diff(pairs[0] >> 32, prepend=-1))       # where each A id begins
                top = np.maximum.reduceat(counts[0], side)
                best = counts[0] == np.repeat(top, np.diff(np.append(side, len(counts[0]))))
            mine, n, doc, weight = unpack_pairs(blob.as_py())
            where = np.repeat(np.searchsorted(pairs[0], mine), n)
            docs, rank = np.unique(doc, return_inverse=True)
            gained, good = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            np.add.at(gained, rank, counts[0][where] * weight)
            np.add.at(good, rank, best[where] * weight)
            found.append(("gains", name, radix, 0, 0, pack(docs, gained, good)))
        if found:
            yield _rows(found)
    release()


def _told(batches):
    """Rows sorted by (run, kind): the facts of a run's documents, then what they gain."""
    facts = gained = good = at = None

    def out():
        return pa.RecordBatch.from_arrays([*facts.columns, pa.array(good), pa.array(gained)], [*facts.schema.names, "n_best", "count_sum"])

    for batch in batches:
        for kind, name, blob in zip(batch.column("kind").to_pylist(), batch.column("run").to_pylist(), batch.column("blob")):
            if name != at:
                if facts is not None:
                    yield out()
                at, facts = name, pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
                gained, good = np.zeros(len(facts), np.int64), np.zeros(len(facts), np.int64)
            else:
                docs, more, better = unpack(blob.as_py())
                gained[docs] += more
                good[docs] += better
    if facts is not None:
        yield out()
    release()


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", file_a: str | None = None, file_b: str | None = None,
            run: int = RUN, block: int = BLOCK, fan: int = FAN, side: int = SIDE) -> DataFrame:
    """Per row of ``docs``: tokens of A and B, groups, links, best links, sum of the counts of the
    links, and digest of the groups."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Aligner(file_a or public_tokenizers.path(FILE_A), file_b or public_tokenizers.path(FILE_B)))
    kind = docs.schema[key].dataType
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    filed = Stored(docs.mapInArrow(_filed(shared, to_arrow_type(kind), run, block), RUNS), "runs", by=["kind"])
    counts, spent = filed.read().where("kind = 'counts'"), []
    runs = filed.read().where("kind = 'facts'").count()
    merges = runs
    while True:
        merges = max(1, math.ceil(merges / fan))
        into = F.pmod(F.xxhash64("run"), F.lit(merges)).cast("string")
        dealt = counts.withColumn("run", into).repartition("radix", "run").sortWithinPartitions("radix", "run", "first")
        spent.append(Stored(dealt.mapInArrow(_merged(block), RUNS), "counts"))
        counts = spent[-1].read()
        if merges == 1:
            break
    slots = max(1, math.ceil(runs / side))
    columns = ["kind", "run", "radix", "slot", "part", "blob"]
    sides = (counts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).select(*columns)
             .unionByName(filed.read().where("kind = 'records'").withColumn("slot", F.pmod(F.xxhash64("run"), F.lit(slots)).cast("int")).select(*columns)))
    gains = sides.repartition("radix", "slot").sortWithinPartitions("radix", "slot", "kind", "part").mapInArrow(_past, RUNS)
    both = filed.read().where("kind = 'facts'").select("kind", "run", "blob").unionByName(gains.select("kind", "run", "blob"))
    schema = f"doc_id {kind.simpleString()}, {FACTS}, n_best long, count_sum long"
    told = Stored(both.repartition("run").sortWithinPartitions("run", "kind").mapInArrow(_told, schema), "aligned")
    for stored in [filed, *spent]:
        stored.drop()
    return told.read().withColumnRenamed("doc_id", key)


@query("op13_alignment")
def op13_alignment(spark, folder):
    """Every document encoded by both tokenizers and aligned."""
    found = aligned(table(spark, folder, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
