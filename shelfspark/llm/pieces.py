"""Piece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a SentencePiece model file (a parameter; nothing is trained).  A text gets a
leading marker, spaces become markers, and the segmentation with the highest sum of log scores
wins.  A character without a piece of its own costs 10 less than the worst piece and is written as
its UTF-8 bytes.  Where a model's scores are merge ranks, which are no log probabilities, a piece
of rank r gets Zipf's ``-ln r - ln H`` instead.

A piece holds the marker only at its front (or nothing else), so the best path of a text is that
of its units put together: a unit starts where markers start, and at each line end or tab.  Each
distinct unit is encoded once per worker: units of a length class are searched together, one
vectorised trie step for all of them; the memory of units is emptied when it is full, which costs
time only.

Decoding concatenates the bytes of the pieces and drops the leading marker; it restores the text
exactly, a literal marker character included, since that is encoded as bytes.

Cases: null text has null tokens; empty text has none; equal scores prefer the longer last piece;
extra columns pass through, one named like an output is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import append, query, table

MARK = "▁"
MODEL = "piece_bpe_32k.model"
PENALTY = 10.0
LONGEST = 64        # bytes of a unit searched together with others; longer units go one by one
MEMORY = 250_000    # units a worker remembers
UNIT = re.compile(r" +[^ \n\t]*|[\n\t]|[^ \n\t]+")


class DoubleArray:
    """Trie over byte strings in two arrays: the child of node s by byte b is t = base[s] + b, and
    exists if check[t] == s.  ``value[t]`` is the number of the string that ends there, or -1."""

    def __init__(self, strings: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for string, number in strings.items():
            node = 0
            for byte in string:
                step = children[node].get(byte)
                if step is None:
                    step = children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = step
            ends[node] = number
        size = 2 * len(children) + 1024
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        used, free, queue = bytearray(size), 257, [(0, 0)]
        used[0] = 1
        for node, slot in queue:
            self.value[slot] = ends[node]
            own = sorted(children[node])
            if not own:
                self.base[slot] = 0
                continue
            while used[free]:
                free += 1
            at = free - own[0]
            while any(used[at + byte] for byte in own):
                at += 1
                if at + 256 >= len(used):
                    grow = len(used)
                    used.extend(bytes(grow))
                    self.base, self.check, self.value = (np.concatenate([a, np.full(grow, v, np.int32)])
                                                         for a, v in ((self.base, 0), (self.check, -1), (self.value, -1)))
            self.base[slot] = at
            for byte in own:
                used[at + byte] = 1
                self.check[at + byte] = slot
                queue.append((children[node][byte], at + byte))
        last = int(np.flatnonzero(np.frombuffer(bytes(used), np.uint8))[-1]) + 257
        self.base, self.check, self.value = (np.ascontiguousarray(np.pad(a, (0, max(0, last - len(a))), constant_values=-1)[:last])
                                             for a in (self.base, self.check, self.value))


class Vocabulary:
    """Pieces of a model file with log scores, as trie and tables; small, and broadcast."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.digest = hashlib.sha256(raw).hexdigest()
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        count = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * count
        self.fallback = np.zeros(256, np.int32)
        normal, rank = {}, np.zeros(count)
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.fallback[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                if not set(piece) & set("\n\t"):
                    normal[piece.replace(MARK, " ").encode()] = i
                rank[i] = model.get_score(i)
        ids = np.array(sorted(normal.values()))
        if (rank[ids] == np.round(rank[ids])).all():
            rank[ids] = -np.log(np.arange(1, len(ids) + 1)) - math.log((1 / np.arange(1, len(ids) + 1)).sum())
        self.score = rank
        self.unknown = float(rank[ids].min()) - PENALTY
        self.trie = DoubleArray(normal)
        self.deepest = max(map(len, normal))

    def together(self, units: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of units of at most LONGEST bytes, searched side by side."""
        n, lengths = len(units), np.array([len(u) for u in units])
        width = int(lengths.max(initial=0))
        grid = np.zeros((n, width + 1), np.uint8)
        flat = np.frombuffer(b"".join(units), np.uint8)
        row = np.repeat(np.arange(n), lengths)
        grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        size = np.zeros((n, width + 1), np.int16)
        piece = np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero((lengths > i) & (grid[:, i] & 0xC0 != 0x80))
            lead = grid[rows, i]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            alone = np.ones(len(rows), bool)
            node, live = np.zeros(len(rows), np.int32), np.arange(len(rows))
            for depth in range(1, min(self.deepest, width - i) + 1):
                step = base[node] + grid[rows[live], i + depth - 1]
                fits = (check[step] == node) & (lengths[rows[live]] >= i + depth)
                live, node = live[fits], step[fits]
                if not len(live):
                    break
                ends = value[node] >= 0
                if ends.any():
                    who = live[ends]
                    self._offer(best, size, piece, rows[who], i, depth, best[rows[who], i] + self.score[value[node[ends]]], value[node[ends]])
                    alone[who] &= char[who] != depth
            for width_of in (1, 2, 3, 4):
                who = rows[alone & (char == width_of)]
                if len(who):
                    self._offer(best, size, piece, who, i, width_of, best[who, i] + self.unknown, np.full(len(who), -1, np.int32))
        return self._paths(flat, lengths, size, piece)

    @staticmethod
    def _offer(best, size, piece, rows, i, depth, score, ids):
        better = score > best[rows, i + depth]
        rows = rows[better]
        best[rows, i + depth], size[rows, i + depth], piece[rows, i + depth] = score[better], depth, ids[better]

    def _paths(self, flat, lengths, size, piece):
        """Follows the back pointers of all units at once; a step without a piece gives its bytes."""
        at, rows, steps = lengths.astype(np.int64), np.flatnonzero(lengths > 0), []
        while len(rows):
            end = at[rows]
            steps.append((rows, end, size[rows, end].astype(np.int64), piece[rows, end]))
            at[rows] -= steps[-1][2]
            rows = rows[at[rows] > 0]
        if not steps:
            return [b""] * len(lengths)
        row, end, width, number = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((end, row))
        row, end, width, number = row[order], end[order], width[order], number[order]
        count = np.where(number >= 0, 1, width)
        first = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), np.int32)
        ids[first[number >= 0]] = number[number >= 0]
        spelled = np.flatnonzero(number < 0)
        if len(spelled):
            n = count[spelled]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place = (np.cumsum(lengths) - lengths)[row[spelled]] + end[spelled] - width[spelled]
            ids[np.repeat(first[spelled], n) + inner] = self.fallback[flat[np.repeat(place, n) + inner]]
        stops = (4 * np.cumsum(np.bincount(row, weights=count, minlength=len(lengths)).astype(np.int64))).tolist()
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *stops], stops)]

    def single(self, unit: bytes) -> bytes:
        """Ids of one long unit."""
        n = len(unit)
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self.lists()
        for i in range(n):
            lead = unit[i]
            if lead & 0xC0 == 0x80:
                continue
            char = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, alone, here = 0, True, best[i]
            for end in range(i, min(n, i + self.deepest)):
                step = base[node] + unit[end]
                if check[step] != node:
                    break
                node = step
                number = value[node]
                if number >= 0:
                    if here + score[number] > best[end + 1]:
                        best[end + 1], back[end + 1] = here + score[number], (i, number)
                    alone &= end + 1 - i != char
            if alone and here + self.unknown > best[i + char]:
                best[i + char], back[i + char] = here + self.unknown, (i, -1)
        ids, at = [], n
        while at:
            start, number = back[at]
            ids.extend([number] if number >= 0 else self.fallback[list(unit[start:at][::-1])].tolist())
            at = start
        return np.array(ids[::-1], np.int32).tobytes()

    def lists(self):
        if not hasattr(self, "_lists"):
            self._lists = tuple(a.tolist() for a in (self.trie.base, self.trie.check, self.trie.value, self.score))
        return self._lists

    def byte_table(self):
        """Bytes of all pieces in one array, with the start and the length of each."""
        if not hasattr(self, "_table"):
            size = np.array([len(x) for x in self.bytes_of], np.int64)
            self._table = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(size) - size, size
        return self._table

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_lists", "_table")}

    def encode_units(self, units: list[str], memory: dict[str, bytes]) -> None:
        """Adds the ids of the given units to ``memory``."""
        short: dict[int, list[str]] = {}
        for unit in units:
            size = len(unit.encode("utf-8", "replace"))
            if MARK in unit:
                memory[unit] = self.marked(unit)
            elif size > LONGEST:
                memory[unit] = self.single(unit.encode("utf-8", "replace"))
            else:
                short.setdefault(max(4, 1 << (size - 1).bit_length()), []).append(unit)
        for group in short.values():
            for i in range(0, len(group), 8192):
                part = group[i:i + 8192]
                memory.update(zip(part, self.together([u.encode("utf-8", "replace") for u in part])))

    def marked(self, unit: str) -> bytes:
        """Ids of a unit with literal marker characters, which become bytes."""
        literal = self.fallback[list(MARK.encode())].astype(np.int32).tobytes()
        return literal.join(self.single(part.encode("utf-8", "replace")) for part in unit.split(MARK))


_MEMORY: dict[str, bytes] = {}
_OWNER: list = [None]


def encode_texts(vocabulary: Vocabulary, texts: list[str | None]) -> list[bytes | None]:
    """Ids of each text as int32 bytes."""
    if _OWNER[0] != vocabulary.digest:
        _MEMORY.clear()
        _OWNER[0] = vocabulary.digest
    out: list[bytes | None] = []
    i = 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and size < 1 << 20:
            text = texts[i]
            group.append(UNIT.findall(" " + text) if text else text)
            size += len(text or "")
            i += 1
        if len(_MEMORY) > MEMORY:
            _MEMORY.clear()
        missing = {unit for units in group if units for unit in units} - _MEMORY.keys()
        if missing:
            vocabulary.encode_units(sorted(missing), _MEMORY)
        out += [b"".join(map(_MEMORY.__getitem__, units)) if units else None if units is None else b"" for units in group]
    return out


def forget() -> None:
    _MEMORY.clear()


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")


def decode_lists(vocabulary: Vocabulary, column: pa.ListArray) -> pa.Array:
    """The texts that lists of ids spell: bytes gathered for all of them from one table."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    ids = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    table, start, size = vocabulary.byte_table()
    width = size[ids]
    ends = np.concatenate([[0], np.cumsum(width)])
    data = table[np.repeat(start[ids] - ends[:-1], width) + np.arange(int(ends[-1]))]
    at = ends[offsets - offsets[0]]
    held = at[1:] > at[:-1]
    keep = np.ones(len(data), bool)
    keep[at[:-1][held]] = False         # the leading marker
    stops = (at - np.concatenate([[0], np.cumsum(held)])).astype(np.int64)
    buffers = [None, pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(data[keep]))]
    raw = pa.Array.from_buffers(pa.large_binary(), len(column), buffers)
    gone = column.is_null()
    try:
        texts = raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:     # ids that are no text
        texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
    return pc.if_else(gone, pa.scalar(None, pa.string()), texts) if column.null_count else texts


def shared_vocabulary(df: DataFrame, model: str | None = None):
    return df.sparkSession.sparkContext.broadcast(Vocabulary(model or public_tokenizers.path(MODEL)))


def _lists(parts: list[bytes | None]) -> pa.Array:
    sizes = np.fromiter((len(p or b"") // 4 for p in parts), np.int64, len(parts))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    offsets = pa.array(ends, pa.int32(), mask=np.array([p is None for p in parts] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(p or b"" for p in parts), np.int32)))


def encode(docs: DataFrame, text: str = "text", model: str | None = None, shared=None) -> DataFrame:
    """``docs`` with ``tokens``, the piece ids of ``text``."""
    shared = shared or shared_vocabulary(docs, model)

    def make(batch):
        return [_lists(encode_texts(shared.value, batch.column(text).to_pylist()))]
    return append(docs, "tokens array<int>", make, forget)


def decode(docs: DataFrame, tokens: str = "tokens", model: str | None = None, shared=None) -> DataFrame:
    """``docs`` with ``decoded``, the text that the piece ids in ``tokens`` spell."""
    shared = shared or shared_vocabulary(docs, model)

    def make(batch):
        return [decode_lists(shared.value, batch.column(tokens))]
    return append(docs, "decoded string", make)


def tokenized(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encodes the texts, decodes the ids again: doc_id, tokens, their number, and whether the
    decoded text equals the original."""
    shared = shared_vocabulary(docs, model)
    both = decode(encode(docs.select("doc_id", "text"), shared=shared), shared=shared)
    return both.select("doc_id", "tokens", F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"),
                       F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"), "decoded")


@query("op10_pieces")
def op10_pieces(spark, folder):
    """Every document encoded and decoded."""
    found = tokenized(table(spark, folder, "documents"))
    return found.select("doc_id", F.coalesce(F.length("decoded"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens",
                        F.sha2(F.array_join("tokens", ","), 256).alias("tokens_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
