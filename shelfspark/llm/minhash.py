"""Near-duplicates: circulant MinHash, banding, exact Jaccard verification, components.

Two fixed permutations of the 32-bit integers stand for all hash functions: the first scatters the
shingle hashes, the second is shifted circularly by k for coordinate k, so that coordinate k of a
signature is ``min p2(p1(x) + k mod 2**32)`` over the shingles x of a document.  With 32 bands of 4
coordinates a pair of similarity 0.75 misses every band with probability below 6e-6.

Equal shingle sets are one *set* from the start (smallest id stands for all).  In each band bucket
all sets are compared with the smallest and the largest one only; verified links give components.
Where a bucket then still holds sets of different components, its sets outside the bucket's most
common component are compared with all others of the bucket, in blocks of bounded size, so that no
link between different components is lost; a block gives links only, one for each two components it
joins, never its pairs.  Links are verified on the full shingle sets.
Components come from star contraction: every round writes a table, so lineage stays short and lost
executors cost no more than a round.

Cases: null, empty and wordless texts have no shingles, link with nothing and stay; a text of fewer
words than a shingle is one shingle; a doc_id that occurs twice counts once for links; extra
columns are ignored by ``near_duplicates`` and kept by ``without_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import Stored, Words, blocks, mix64, query, runs, table, text_bytes

WIDTH = 5
BANDS, ROWS = 32, 4
KIND = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
PART = 1024         # sets that one side of a block of the second comparison holds
WEIGHT = 1 << 19    # and their shingles
COLUMNS = 4096      # shingles counted together in a block


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """(document, hash), sorted and distinct, of every run of ``width`` words."""
    words = Words(data, offsets, KIND)
    hashes, docs = runs(words.hash, width), words.doc[:max(len(words.doc) - width + 1, 0)]
    inside = docs == words.doc[width - 1:]
    docs, hashes = docs[inside], hashes[inside]
    count = np.diff(words.at)
    for doc in np.flatnonzero((count > 0) & (count < width)):
        docs = np.append(docs, doc)
        hashes = np.append(hashes, runs(words.hash[words.at[doc]:words.at[doc + 1]], int(count[doc])) ^ np.uint64(count[doc]))
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash signatures of consecutive non-empty groups that begin at ``first``."""
    scattered = _permute((hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((len(first), size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(_permute(scattered + np.uint32(k), 0x21F0AAAD, 0xD35A2D97), first)
    return out


def _groups(docs: np.ndarray):
    """Start of each run of equal values, and the values."""
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    return first, docs[first]


def _sketch(key: str, text: str, width: int, size: int):
    """Per document the number of shingles, a digest of the set, and its signature (null if empty)."""
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            n = np.zeros(batch.num_rows, np.int64)
            a, b = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            signed: list[bytes | None] = [None] * batch.num_rows
            for i, j in blocks(offsets):
                docs, hashes = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
                first, which = _groups(docs)
                if len(first):
                    n[which + i] = np.diff(np.append(first, len(docs)))
                    a[which + i] = np.add.reduceat(mix64(hashes), first)
                    b[which + i] = np.add.reduceat(mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                    for doc, row in zip(which + i, signatures(hashes, first, size)):
                        signed[doc] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(signed, pa.binary())],
                [key, "n_shingles", "set_a", "set_b", "signature"])
    return run


def _sets(text: str, width: int):
    """Shingle hashes of the chosen documents, sorted."""
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            for i, j in blocks(offsets):
                docs, hashes = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
                ends = np.searchsorted(docs, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("set_id").slice(i, j - i),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))],
                    ["set_id", "hashes"])
    return run


def _banded(bands: int, rows: int):
    """One row per band of a signature."""
    def run(batches):
        for batch in batches:
            grid = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, bands * rows)
            keys = np.zeros((len(grid), bands), np.uint64)
            for r in range(rows):
                keys = mix64(keys ^ grid[:, r::rows][:, :bands].astype(np.uint64)) + np.uint64(r + 1)
            keys = mix64(keys ^ np.arange(bands, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("set_id").to_numpy(), bands)),
                                              pa.array(np.repeat(batch.column("n_shingles").to_numpy(), bands)),
                                              pa.array(keys.ravel().view(np.int64))], ["set_id", "n_shingles", "bucket"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b): the smallest id reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks once more, and keeps
    the edges between different hooks; at least half of the nodes go each time."""
    edges = Stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("component", kind)])
    every, kept = edges.spark.createDataFrame([], schema), None
    while not edges.read().isEmpty():
        now = edges.read()
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = Stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "hooks")
        upper = hook.read().select(F.col("a").alias("up"), F.col("up").alias("top"))
        jumped = Stored(hook.read().join(upper, "up").select(F.col("a").alias("id"), F.col("top").alias("component")), "jumped")
        to = jumped.read()
        moved = (every.withColumnRenamed("component", "was").join(to.withColumnRenamed("id", "was"), "was", "left")
                 .select("id", F.coalesce("component", "was").alias("component")))
        known = Stored(moved.unionAll(to.join(every.select("id"), "id", "left_anti")), "components")
        a = to.select(F.col("id").alias("a"), F.col("component").alias("x"))
        b = to.select(F.col("id").alias("b"), F.col("component").alias("y"))
        further = Stored(now.join(a, "a").join(b, "b").where("x <> y")
                         .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        for old in (edges, hook, jumped, *([kept] if kept else [])):
            old.drop()
        edges, every, kept = further, known.read(), known
    edges.drop()
    return every


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    a = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    near = 100 * F.least(F.size("x"), F.size("y")) >= percent * F.greatest(F.size("x"), F.size("y"))
    common = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(b, "b").join(a, "a").where(near)
    return joined.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def cross_links(outside: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Rows (i, j) of one block whose sets reach the similarity: outsiders against members of other
    components.  Of links that join the same components one is enough, and kept."""
    out, rest = np.flatnonzero(outside), np.flatnonzero(~outside)
    size = np.array([len(x) for x in sets])
    if not len(out) or not len(rest):
        return []
    common = np.zeros((len(out), len(rest)), np.float32)
    if common.size <= 8:
        for i, a in enumerate(out):
            for j, b in enumerate(rest):
                if 100 * min(size[a], size[b]) >= percent * max(size[a], size[b]) and component[a] != component[b]:
                    common[i, j] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:       # counts of shared shingles as products of 0/1 matrices, some columns at a time
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        mine, theirs = np.zeros(number.max() + 1, bool), np.zeros(number.max() + 1, bool)
        mine[number[outside[row]]] = True
        theirs[number[~outside[row]]] = True
        place = np.cumsum(mine & theirs) - 1
        keep = (mine & theirs)[number]
        row, column = row[keep], place[number[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        spot = np.empty(len(sets), np.int64)
        spot[out], spot[rest] = np.arange(len(out)), np.arange(len(rest))
        for first in range(0, int(place[-1]) + 1, COLUMNS):
            some = slice(*np.searchsorted(column, [first, first + COLUMNS]))
            x, y = np.zeros((len(out), COLUMNS), np.float32), np.zeros((len(rest), COLUMNS), np.float32)
            own = outside[row[some]]
            x[spot[row[some][own]], column[some][own] - first] = 1
            y[spot[row[some][~own]], column[some][~own] - first] = 1
            common += x @ y.T
    union = size[out][:, None] + size[rest][None, :] - common
    linked = (100 * common >= percent * union) & (component[out][:, None] != component[rest][None, :])
    up: dict[int, int] = {}

    def root(c):
        while up.get(c, c) != c:
            c = up[c]
        return c
    links = []
    for i, j in zip(*np.nonzero(linked)):
        p, q = root(int(component[out[i]])), root(int(component[rest[j]]))
        if p != q:
            up[max(p, q)] = min(p, q)
            links.append((int(out[i]), int(rest[j])))
    return links


def _linked(percent: int):
    """Links of blocks whose rows arrive together, sorted by block."""
    def settle(held):
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ends, values = np.asarray(block.column("hashes").offsets), np.asarray(block.column("hashes").values)
        ids = block.column("set_id").to_numpy()
        links = cross_links(block.column("outside").to_numpy(zero_copy_only=False), block.column("component").to_numpy(),
                            [values[a:b] for a, b in zip(ends[:-1], ends[1:])], percent)
        return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in links]

    def run(batches):
        held, key, links = [], None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "part", "out_part")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
            for first, last in zip(cuts[:-1], cuts[1:]):
                own = tuple(keys[:, first]) if last > first else key
                if own != key and held:
                    links += settle(held)
                    held = []
                key = own
                held.append(batch.slice(first, last - first))
            yield _pairs(links)
            links = []
        if held:
            yield _pairs(settle(held))
    return run


def _pairs(links: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def _second_links(members: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links between different components that still share a bucket."""
    labelled = (members.join(known.withColumnRenamed("id", "set_id"), "set_id", "left")
                .withColumn("component", F.coalesce("component", "set_id")))
    per = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    most = F.max(F.struct("n", "component", "weight"))
    parts = lambda n, weight: F.ceil(F.greatest(n / PART, weight / WEIGHT, F.lit(1)))      # noqa: E731
    mixed = (per.groupBy("bucket").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("weight").alias("weight")).where("most.n < n")
             .select("bucket", F.col("most.component").alias("common"), parts(F.col("n"), F.col("weight")).alias("parts"),
                     parts(F.col("n") - F.col("most.n"), F.col("weight") - F.col("most.weight")).alias("out_parts")))
    rows = labelled.join(mixed, "bucket").join(sets, "set_id").withColumn("spot", F.abs(F.xxhash64("set_id")))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)     # noqa: E731
    outsider = F.col("component") != F.col("common")
    as_out = F.when(outsider, F.transform(numbers(F.col("parts")), lambda p: F.struct(
        p.alias("part"), (F.col("spot") % F.col("out_parts")).alias("out_part"), F.lit(True).alias("outside"))))
    as_rest = F.transform(numbers(F.col("out_parts")), lambda p: F.struct(
        (F.col("spot") % F.col("parts")).alias("part"), p.alias("out_part"), F.lit(False).alias("outside")))
    blocks = rows.withColumn("at", F.explode(F.concat(F.coalesce(as_out, F.array()), as_rest)))
    return (blocks.select("bucket", "at.part", "at.out_part", "at.outside", "set_id", "component", "hashes")
            .repartition("bucket", "part", "out_part").sortWithinPartitions("bucket", "part", "out_part")
            .mapInArrow(_linked(percent), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = 75,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: key, ``n_shingles``, ``component_id`` (smallest key reachable over links)."""
    size = bands * rows
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = Stored(docs.mapInArrow(_sketch("doc_id", "text", width, size),
                                      "doc_id long, n_shingles long, set_a long, set_b long, signature binary"), "sketches")
    keyed = sketched.read().select("doc_id", "n_shingles", "set_a", "set_b")
    of_set = keyed.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("set_id"))
    distinct = Stored(of_set.join(sketched.read().select(F.col("doc_id").alias("set_id"), "signature").where("signature is not null"), "set_id")
                      .dropDuplicates(["set_id"]), "distinct-sets")
    banded = Stored(distinct.read().select("set_id", "n_shingles", "signature")
                    .mapInArrow(_banded(bands, rows), "set_id long, n_shingles long, bucket long"), "bands")
    shared = banded.read().groupBy("bucket").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high")
    members = Stored(banded.read().join(shared, "bucket"), "buckets")
    banded.drop()
    chosen = members.read().select("set_id").distinct()
    sets = Stored(docs.join(chosen, docs["doc_id"] == chosen["set_id"]).select("set_id", "text").dropDuplicates(["set_id"])
                  .mapInArrow(_sets("text", width), "set_id long, hashes array<long>"), "shingle-sets")
    first = (members.read().select(F.explode(F.array("low", "high")).alias("a"), F.col("set_id").alias("b")).where("a <> b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = Stored(verified(first, sets.read(), percent), "links")
    known = components(links.read())
    second = Stored(_second_links(members.read().select("set_id", "bucket", "n_shingles"), sets.read(), known, percent), "second-links")
    found = components(links.read().unionAll(second.read()))
    result = Stored(keyed.join(distinct.read().select("set_a", "set_b", "set_id"), ["set_a", "set_b"], "left")
                    .join(found.withColumnRenamed("id", "set_id"), "set_id", "left")
                    .select(F.col("doc_id").alias(key), "n_shingles",
                            F.when(F.col("n_shingles") > 0, F.coalesce("component", "set_id")).otherwise(F.col("doc_id")).alias("component_id")), "near-duplicates")
    for old in (sketched, distinct, members, sets, links, second):
        old.drop()
    return result.read()


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Of each component the row with the smallest key, columns unchanged."""
    gone = near_duplicates(docs, key=key, **options).where(F.col("component_id") != F.col(key)).select(F.col(key).alias("_gone"))
    return docs.join(gone, F.col(key) == F.col("_gone"), "left_anti")


@query("op6_minhash", r"""with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[i:i + 4], ' ') as sh from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
g as (select a as x, b as y from e union all select b, a from e),
r(doc_id, node) as (select doc_id, doc_id from w union select r.doc_id, g.y from r join g on g.x = r.node),
c as (select doc_id, min(node) as component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, component_id = doc_id as kept from c left join n using (doc_id)""")
def op6_minhash(spark, folder):
    """Near-duplicate components of all documents: five-word shingles, similarity of 0.75."""
    return near_duplicates(table(spark, folder, "documents")).withColumn("kept", F.col("component_id") == F.col("doc_id"))
