"""Presence, absence and similarity between two collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import (
    col, filled, fold_text, jaccard_of, leading_int, overlap_of, title_author_key, tokens,
)
from shelfspark.operators.keyed import attach_by_key, exact_rank, top_per_key
from shelfspark.session import arrow_place, materialise, scratch


def bare_code(c) -> Column:
    return F.trim(F.replace(col(c).cast("string"), F.lit("-"), F.lit("")))


def absent_by_id(candidates: DataFrame, key, *others: tuple[DataFrame, str]) -> DataFrame:
    """Candidates whose code (hyphens stripped) is in none of the other lists."""
    out = candidates.withColumn("_code", bare_code(key))
    for frame, column in others:
        out = out.join(frame.select(bare_code(column).alias("_code")).distinct(), "_code", "left_anti")
    return out.drop("_code")


def absent_by_title(candidates: DataFrame, title, holdings: DataFrame, held_title) -> DataFrame:
    """Candidates whose folded title is not held (empty titles are dropped)."""
    return _by_title(candidates, title, holdings, held_title, "left_anti")


def present_by_title(candidates: DataFrame, title, holdings: DataFrame, held_title) -> DataFrame:
    return _by_title(candidates, title, holdings, held_title, "left_semi")


def _by_title(candidates, title, holdings, held_title, how):
    # Texts can be long: the folded form travels as its 256-bit digest.  The
    # empty form is treated in the key set, so no text is folded twice.
    nothing = candidates.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("_t"))
    held = holdings.select(F.sha2(fold_text(held_title), 256).alias("_t")).distinct()
    held = (held.unionByName(nothing) if how == "left_anti"
            else held.where(F.col("_t") != F.sha2(F.lit(""), 256)))
    return (candidates.withColumn("_t", F.sha2(fold_text(title), 256))
            .join(held, "_t", how).drop("_t"))


def already_owned(candidates: DataFrame, holdings: DataFrame, keys: dict[str, tuple]) -> DataFrame:
    """One flag per key kind and their disjunction.

    ``keys``: name -> (candidate expression, holdings expression).  Each flag is
    an equi-join on one key, instead of one join on a disjunction."""
    out = candidates
    for name, (mine, theirs) in keys.items():
        held = (holdings.select(theirs.alias("_k")).where(F.col("_k").isNotNull()).distinct()
                .withColumn("_hit", F.lit(True)))
        out = (out.withColumn("_k", mine).join(held, "_k", "left")
               .withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit"))
    any_of = F.lit(False)
    for name in keys:
        any_of = any_of | F.col(name)
    return out.withColumn("owned", any_of)


def book_keys(isbn, series, volume, title, author) -> dict[str, Column]:
    """The three keys a book is recognised by; NULL where incomplete."""
    number = leading_int(col(volume).cast("string"))
    return {
        "by_isbn": F.when(filled(isbn), bare_code(isbn)),
        "by_volume": F.when(filled(series) & number.isNotNull(), F.concat(
            fold_text(series, "drop"), F.lit("#"), number.cast("string"))),
        "by_title": title_author_key(title, author),
    }


def fill_from_child(parent: DataFrame, child: DataFrame, key, column, default) -> DataFrame:
    """Missing value taken from any child row (the smallest), else a default."""
    found = (child.where(filled(F.col(column).cast("string"))).groupBy(key)
             .agg(F.min(column).alias("_found")))
    own = F.when(filled(F.col(column).cast("string")), F.col(column))
    return (parent.join(found, key, "left")
            .withColumn(column, F.coalesce(own, F.col("_found"), F.lit(default))).drop("_found"))


def order_reconciliation(orders: DataFrame, deliveries: DataFrame, key, ordered, delivered) -> DataFrame:
    """Ordered minus delivered; deliveries are summed before the join."""
    sums = deliveries.groupBy(key).agg(F.sum(delivered).alias("delivered"))
    got = F.coalesce("delivered", F.lit(0))
    return (orders.join(sums, key, "left")
            .select(key, F.col(ordered).alias("ordered"), got.alias("delivered"),
                    (F.col(ordered) - got).alias("gap")))


def dictionary_lookup(df: DataFrame, column, table: DataFrame, code, label) -> DataFrame:
    """Exact code -> label; Spark picks the join from measured sizes."""
    return df.join(table.select(F.col(code).alias(column), F.col(label).alias("label")), column, "left")


def update_by_mapping(df: DataFrame, column, mapping: DataFrame, old, new) -> DataFrame:
    """Apply an approved value mapping; ``changed`` tells the rows it touched."""
    table = (mapping.where(F.col(old) != F.col(new))
             .select(F.col(old).alias(column), F.col(new).alias("_new")).distinct())
    return (df.join(table, column, "left").withColumn("changed", F.col("_new").isNotNull())
            .withColumn(column, F.coalesce("_new", column)).drop("_new"))


def attach_proposal(missing: DataFrame, found: DataFrame, key) -> DataFrame:
    return missing.join(found, key, "left")


def regretted_withdrawals(withdrawn: DataFrame, requests: DataFrame, isbn, title, withdrawn_on,
                          requested_on) -> DataFrame:
    """Withdrawn and requested later: same code or same folded title, in time
    order.  Two equi-joins on earliest withdrawal per key, then one row per
    request."""
    w = withdrawn.select(bare_code(isbn).alias("code"), fold_text(title).alias("t"),
                         F.col(withdrawn_on).alias("withdrawn_on"))
    by_code = w.where(F.col("code") != "").groupBy("code").agg(F.min("withdrawn_on").alias("_c"))
    by_title = w.where(F.col("t") != "").groupBy("t").agg(F.min("withdrawn_on").alias("_t"))
    r = requests.withColumn("code", bare_code(isbn)).withColumn("t", fold_text(title))
    first = F.least("_c", "_t")
    return (r.join(by_code, "code", "left").join(by_title, "t", "left")
            .withColumn("first_withdrawn", first).where(F.col(requested_on) > F.col("first_withdrawn"))
            .drop("code", "t", "_c", "_t"))


# --- similarity --------------------------------------------------------------------------

def _token_sets(df: DataFrame, key, text, punct) -> DataFrame:
    """Key, words and digest of the word set of each text that has any."""
    words = F.sort_array(tokens(text, punct))
    sets = df.select(F.col(key).alias("_id"), text).select("_id", words.alias("words"))
    return (sets.where(F.size("words") > 0)
            .withColumn("set_key", F.sha2(F.array_join("words", " "), 256)))


def _prefixes(words: DataFrame, threshold: float) -> DataFrame:
    """(side, set_key, word, n, place) of the words a set is found by: the first
    n - ceil(threshold * n) + 1 of its n words, in the order of the number of
    pairs they would bring (left sets times right sets holding the word).

    Two sets reaching the threshold share at least one of these words, whatever
    the common order; this order makes the groups per word as small as can be,
    and words of one side only, which come first, bring none at all."""
    cost = words.groupBy("word").agg(
        (F.sum(1 - F.col("side")) * F.sum("side")).alias("cost"), F.count(F.lit(1)).alias("freq"))
    ranked = attach_by_key(words, cost, "word", "freq")
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")).cast("int") + 1
    kept = (ranked.groupBy("side", "set_key", "n")
            .agg(F.sort_array(F.collect_list(F.struct("cost", "word"))).alias("_w"))
            .select("side", "set_key", "n", F.posexplode(F.slice("_w", F.lit(1), keep)).alias("place", "_w")))
    return kept.where(F.col("_w.cost") > 0).select(
        "side", "set_key", F.col("_w.word").alias("word"), "n", "place")


def similar_sets(lefts: DataFrame, rights: DataFrame, threshold: float, method: str = "jaccard") -> DataFrame:
    """(a, b, score) of the pairs of word sets reaching the threshold.

    Both sides: one row per ``set_key`` with its ``words``.  Two sets meet only through one of the
    words that bring fewest pairs (prefix filtering), and when the words still to come allow the
    score; the result equals comparing all pairs.  ``jaccard``: common over all words; ``overlap``:
    common over the longer count."""
    score_of = jaccard_of if method == "jaccard" else overlap_of
    words = [sets.select(F.lit(side).alias("side"), "set_key", F.size("words").alias("n"), F.explode("words").alias("word"))
             for side, sets in enumerate((lefts, rights))]
    found_by = materialise(_prefixes(words[0].unionByName(words[1]), threshold), "prefixes")
    a, b = [found_by.where(F.col("side") == side).select(
        F.col("set_key").alias(x), F.col("n").alias(f"n_{x}"), F.col("place").alias(f"at_{x}"), "word")
        for side, x in enumerate("ab")]
    # Words before the first shared one are not shared: the words still to come
    # bound what two sets can share, and that must reach the wanted score.
    reachable = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    both = F.col("n_a") + F.col("n_b")
    needed = (both * (threshold / (1 + threshold)) if method == "jaccard"
              else F.greatest("n_a", "n_b") * threshold)
    pairs = a.join(b, "word").where(reachable >= needed - 1e-6).select("a", "b").distinct()
    return (pairs.join(lefts.select(F.col("set_key").alias("a"), F.col("words").alias("wa")), "a")
            .join(rights.select(F.col("set_key").alias("b"), F.col("words").alias("wb")), "b")
            .select("a", "b", score_of(F.col("wa"), F.col("wb")).alias("score"))
            .where(F.col("score") >= threshold))


def similar_texts(left: DataFrame, left_text, right: DataFrame, right_text, threshold: float) -> DataFrame:
    """(left_text, right_text, score) of the distinct texts whose words are similar enough."""
    sides = [materialise(_token_sets(df.select(F.col(text).alias("text")).distinct(), "text", "text", "drop"), "words")
             for df, text in ((left, left_text), (right, right_text))]
    sets = [side.groupBy("set_key").agg(F.first("words").alias("words")) for side in sides]
    scored = similar_sets(*sets, threshold)
    return (scored.join(sides[0].select(F.col("_id").alias("left_text"), F.col("set_key").alias("a")), "a")
            .join(sides[1].select(F.col("_id").alias("right_text"), F.col("set_key").alias("b")), "b")
            .select("left_text", "right_text", "score"))


# Fixed values of the comparison in cells: words of a block at most, blocks a side is cut into at
# least, commonest words of a cell compared as bits, numbers held at once while a cell is counted,
# hits among its rarest words that a pair needs to be counted, words numbered without a shuffle.
CELL_WORDS, CELL_BLOCKS, CELL_BITS, CELL_ROOM, CELL_HITS, COMMON_WORDS = 4_000_000, 8, 512, 2_000_000, 8, 262_144
CELL_TASKS = 2_000


def _numbers(common: list[str]):
    """The numbers (1, 2, ...) of the ``common`` words of each row, and its other words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        table = pa.array(common, pa.string())
        for batch in batches:
            words = batch.column("words")
            flat, counts = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            ids = pc.fill_null(pc.index_in(flat, value_set=table), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            at = ids > 0
            inside = np.sort(row[at] * (len(common) + 1) + ids[at])

            def lists(rows, values):
                ends = np.cumsum(np.bincount(rows, minlength=len(counts)))
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("side", "set_key", "n", "first")],
                 lists(row[at], pa.array(inside % (len(common) + 1), pa.int32())), lists(row[~at], flat.filter(pa.array(~at)))],
                names=["side", "set_key", "n", "first", "ids", "rest"])
    return run


def _numbered_sets(sides: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(side, set_key, n, first, ids, rest): of each text the digest of its words, their number, its
    key, the numbers of its commonest words and its other words; and (side, set_key, more), the
    numbers of those of the other words that both sides know.  Common words have small numbers.

    A fixed number of words, which make up most of all texts, is looked up where the texts are; only
    the others are shuffled to be numbered.  ``sides``: _id, words, set_key."""
    def told(columns):
        both = [df.select(F.lit(side).alias("side"), *columns) for side, df in enumerate(sides)]
        return both[0].unionByName(both[1])
    words = told([F.explode("words").alias("word")]).groupBy("word").agg(
        F.sum(1 - F.col("side")).alias("_l"), F.sum("side").alias("_r")).where((F.col("_l") > 0) & (F.col("_r") > 0))
    ranked = exact_rank(words.select("word", (-F.col("_l") * F.col("_r")).alias("_cost"), F.lit(0).alias("_all")), ["_all"], ["_cost", "word"], "id")
    table = materialise(ranked.select("word", F.col("id").cast("int").alias("id")), "vocabulary")
    common = [r["word"] for r in table.where(F.col("id") <= COMMON_WORDS).orderBy("id").collect()]
    rows = told([F.unhex("set_key").alias("set_key"), F.size("words").alias("n"), F.col("_id").alias("first"), "words"])
    kind = rows.schema["first"].dataType.simpleString()
    numbered = materialise(rows.mapInArrow(
        _numbers(common), f"side int, set_key binary, n int, first {kind}, ids array<int>, rest array<string>"), "numbered")
    more = (numbered.select("side", "set_key", F.explode("rest").alias("word")).join(table.where(F.col("id") > COMMON_WORDS), "word")
            .groupBy("side", "set_key").agg(F.sort_array(F.collect_set("id")).alias("more")))
    return numbered, more


def _blocks(sets: DataFrame, threshold: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """(side, band, first block, blocks) of the bands of sizes, and the cells, pairs of blocks that can
    hold similar sets: a set has at least ``threshold`` times the words of one it is similar to.  Few
    rows, whatever the input: four bands for each division by the threshold.  Large cells come first."""
    sizes = sets.groupBy("side", "band").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum(F.col("n") + 8).alias("words")).collect()
    total = [sum(r["words"] for r in sizes if r["side"] == side) for side in (0, 1)]
    plan, weight = {}, []
    for r in sorted(sizes, key=lambda r: (r["side"], r["band"])):
        slices = -(-r["words"] // max(1, min(CELL_WORDS, total[r["side"]] // CELL_BLOCKS)))
        plan[r["side"], r["band"]] = range(len(weight), len(weight) + slices)
        weight += [r["words"] / slices / r["low"]] * slices
    cells = [(i, j) for a in sizes for b in sizes if a["side"] == 0 and b["side"] == 1
             and max(a["low"], b["low"]) * threshold <= min(a["high"], b["high"]) + 1e-6
             for i in plan[0, a["band"]] for j in plan[1, b["band"]]]
    cells.sort(key=lambda c: -weight[c[0]] * weight[c[1]])
    return [(side, band, blocks.start, len(blocks)) for (side, band), blocks in plan.items()], cells


def _best_in_cell(threshold: float, method: str):
    """Compares the left sets of a cell with its right sets; gives each left set its best right one.

    Two sets that must share k words share ``asked`` of them within the rarest (size - k + asked) of
    each, so only these are looked up in an index, and pairs that have so many hits are counted whole."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def needed(a, b):
        """How many words sets of these sizes must share."""
        wanted = (a + b) * (threshold / (1 + threshold)) if method == "jaccard" else np.maximum(a, b) * threshold
        return np.maximum(np.ceil(wanted - 1e-6), 1).astype(np.int64)

    def score_of(shared, a, b):
        return shared / (a + b - shared if method == "jaccard" else np.maximum(a, b))

    def read(table):
        ids = table.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        counts = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        return ids.flatten().to_numpy(zero_copy_only=False), counts, table.column("n").to_numpy().astype(np.float64)

    def flat(starts, sizes):
        """The places start, start + 1, ... of all ranges, one range behind the other."""
        return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    class Side:
        """Words of the sets that both sides of the cell hold, rarest last; of each set the words it is found by."""

        def __init__(self, words, counts, n, place, known, least, asked):
            here = known[words]
            row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[here]
            self.words, self.n = place[words[here]], n
            self.sizes = np.bincount(row, minlength=len(counts))
            self.ends = np.cumsum(self.sizes)
            self.starts = self.ends - self.sizes
            must = needed(n, least)
            found_by = np.where(self.sizes >= must, self.sizes - must + asked, 0)
            self.most = int(found_by.max(initial=0))
            at = np.arange(len(row), dtype=np.int32) >= (self.ends - found_by).astype(np.int32)[row]
            self.rare, self.rare_row = self.words[at], row[at]
            low = self.words < bits
            self.bits = np.zeros((len(counts), bits // 64), np.uint64)
            np.bitwise_or.at(self.bits, (row[low], self.words[low] // 64), np.uint64(1) << (self.words[low] % 64).astype(np.uint64))
            self.others = self.sizes - np.bincount(row[low], minlength=len(counts))
    bits = CELL_BITS

    def best(left, right):
        # rights in the order of their keys: of equal scores the first place wins
        right = right.take(pc.sort_indices(right, sort_keys=[("first", "ascending")], null_placement="at_start"))
        (lw, lc, ln), (rw, rc, rn) = read(left), read(right)
        m, k = len(ln), len(rn)
        known = np.zeros(1 + max(lw.max(initial=0), rw.max(initial=0)), bool)
        theirs = known.copy()
        known[lw], theirs[rw] = True, True
        known &= theirs
        del theirs
        place = np.cumsum(known, dtype=np.int32) - 1
        least = needed(ln.min(), rn.min())
        asked = int(min(max(CELL_HITS, least // 14), least))      # large sets share more words by chance
        a, b = Side(lw, lc, ln, place, known, rn.min(), asked), Side(rw, rc, rn, place, known, ln.min(), asked)
        del lw, rw, known
        first = np.zeros(int(place[-1]) + 2, np.int32)
        np.cumsum(np.bincount(a.rare, minlength=len(first) - 1), out=first[1:])
        holders = a.rare_row[np.argsort(a.rare, kind="stable")]
        sizes = first[b.rare + 1] - first[b.rare]
        some = sizes > 0
        begins, sizes, rows = first[b.rare[some]], sizes[some], b.rare_row[some]
        hits = np.concatenate([[0], np.cumsum(np.bincount(rows, sizes, minlength=k))]).astype(np.int64)
        ends = np.searchsorted(rows, np.arange(k + 1))
        kind = np.uint8 if min(a.most, b.most) < 256 else np.int32
        score, found, mark = np.full(m, -1.0), np.zeros(m, np.int64), np.zeros(len(first), bool)
        room = -(-m // 8) * 8      # a row of the counts, whole words of eight bytes
        at = 0
        while at < k:
            # as many rights at once as the room allows, one at least
            to = min(at + max(1, CELL_ROOM // room), k, max(at + 1, int(np.searchsorted(hits, hits[at] + CELL_ROOM, "right")) - 1))
            if hits[to] == hits[at]:
                at = to
                continue
            part = slice(ends[at], ends[to])
            times = np.zeros((to - at) * room, kind)
            np.add.at(times, np.repeat((rows[part].astype(np.int64) - at) * room, sizes[part]) + holders[flat(begins[part], sizes[part])], kind(1))
            enough = np.flatnonzero((times >= asked).view(np.uint64))
            code = (enough[:, None] * 8 + np.arange(8)).ravel()
            code = code[times[code] >= asked]
            r, l = code // room + at, code % room
            at = to
            # the commonest words as bits bound what the pair can share, and that must beat the best so far
            most = np.zeros(len(r), np.int64)
            for j in range(bits // 64):
                most += np.bitwise_count(b.bits[r, j] & a.bits[l, j])
            most += np.minimum(a.others[l], b.others[r])
            ok = (most >= needed(ln[l], rn[r])) & (score_of(most, ln[l], rn[r]) > score[l])
            r, l = r[ok], l[ok]
            if not len(r):
                continue
            shared = np.zeros(len(r), np.int64)
            turns = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
            for one, end in zip(turns[:-1], turns[1:]):
                mine = b.words[b.starts[r[one]]:b.ends[r[one]]]
                mark[mine] = True
                step = max(1, CELL_ROOM // int(a.sizes[l[one:end]].max()))
                for i in range(one, end, step):
                    some = l[i:min(end, i + step)]
                    counts = a.sizes[some]
                    shared[i:i + len(some)] = np.add.reduceat(mark[a.words[flat(a.starts[some], counts)]], np.cumsum(counts) - counts, dtype=np.int64)
                mark[mine] = False
            s = score_of(shared, ln[l], rn[r])
            ok = s >= threshold
            r, l, s = r[ok], l[ok], s[ok]
            pick = np.lexsort((r, -s, l))
            r, l, s = r[pick], l[pick], s[pick]
            top = np.r_[True, l[1:] != l[:-1]][:len(l)]
            r, l, s = r[top], l[top], s[top]
            better = s > score[l]
            score[l[better]], found[l[better]] = s[better], r[better]
        hit = np.nonzero(score >= 0)[0]
        return pa.table({"set_key": left.column("set_key").take(pa.array(hit)), "right_id": right.column("first").take(pa.array(found[hit])),
                         "score": pa.array(score[hit])})
    return best


def _in_cells(folder: str, cells: list[tuple[int, int]], compare):
    """Reads the two blocks of each cell from the shared folder and compares them."""
    def run(batches):
        import pyarrow.parquet as pq
        fs, inner = arrow_place(folder)

        def read(block):
            path = f"{inner}/block={block}"
            if fs.get_file_info(path).type.name == "NotFound":     # a slice that no set fell into
                return None
            return pq.read_table(path, filesystem=fs, columns=["set_key", "n", "first", "ids"], partitioning=None)
        for batch in batches:
            for number in batch.column("id").to_pylist():
                left, right = (read(block) for block in cells[number])
                if left is not None and right is not None:
                    yield from compare(left, right).to_batches()
    return run


def best_sets(lefts: DataFrame, rights: DataFrame, threshold: float, method: str) -> DataFrame:
    """(set_key, right_id, score): the best right match of each left word set reaching the threshold.

    Texts of many words share common ones with most others, so pairs are not written down: both
    sides are cut into blocks by size and digest, stored once in the shared folder, and each pair of
    blocks that can hold similar sets is read and compared in one task.  The result equals comparing
    all pairs."""
    spark = lefts.sparkSession
    numbered, more = _numbered_sets([lefts, rights])
    step = F.log(F.lit(1 / threshold)) / 4 if threshold < 1 else F.lit(1.0)
    numbered = numbered.withColumn("band", F.floor(F.log("n") / step).cast("int"))
    bands, cells = _blocks(numbered, threshold)
    plan = spark.createDataFrame(bands, "side int, band int, begin int, slices int")
    # one row for each distinct word set of a side, with the words that the other side knows too
    every = numbered.groupBy("side", "set_key").agg(F.min("n").alias("n"), F.min("band").alias("band"), F.min("first").alias("first"), F.first("ids").alias("ids"))
    sets = (every.join(more, ["side", "set_key"], "left")
            .withColumn("ids", F.concat("ids", F.coalesce("more", F.array().cast("array<int>")))).where(F.size("ids") > 0))
    digest = F.conv(F.substring(F.hex("set_key"), 1, 8), 16, 10).cast("bigint")
    count = sum(b[3] for b in bands)
    folder = scratch(spark, "blocks")
    (sets.join(F.broadcast(plan), ["side", "band"]).select((F.col("begin") + digest % F.col("slices")).cast("int").alias("block"), "set_key", "n", "first", "ids")
     .repartition(max(count, 1), "block").write.partitionBy("block").parquet(folder))
    kind = numbered.schema["first"].dataType.simpleString()
    found = (spark.range(0, len(cells), 1, min(max(len(cells), 1), CELL_TASKS))
             .mapInArrow(_in_cells(folder, _dealt(cells, CELL_TASKS), _best_in_cell(threshold, method)), f"set_key binary, right_id {kind}, score double"))
    return (found.groupBy("set_key").agg(F.min(F.struct((-F.col("score")).alias("loss"), "right_id")).alias("best"))
            .select(F.lower(F.hex("set_key")).alias("set_key"), F.col("best.right_id").alias("right_id"), (-F.col("best.loss")).alias("score")))


def _dealt(cells: list, hands: int) -> list:
    """The cells in another order: cut into as many runs, each has large and small ones."""
    return [cell for hand in range(min(hands, len(cells))) for cell in cells[hand::hands]]


def fuzzy_title_match(left: DataFrame, left_key, left_text, right: DataFrame, right_key, right_text,
                      threshold: float, method: str = "jaccard") -> DataFrame:
    """Best right match of each left text reaching the threshold.

    Exact (see ``best_sets``); equal word sets are handled once.  Ties go to the smallest right key."""
    punct = "drop" if method == "jaccard" else "space"
    # Folding and splitting whole texts is the costly part and both sides are
    # read several times below: done once, kept in the shared folder.
    lefts = materialise(_token_sets(left, left_key, left_text, punct), "words")
    rights = materialise(_token_sets(right, right_key, right_text, punct), "words")
    best = materialise(best_sets(lefts, rights, threshold, method), "best")
    copies = lefts.groupBy("set_key").agg(F.count(F.lit(1)).alias("copies"))
    return (attach_by_key(lefts.select("_id", "set_key"), best.join(copies, "set_key"), "set_key", "copies")
            .where(F.col("right_id").isNotNull())
            .select(F.col("_id").alias("left_id"), "right_id", "score"))


def _rarest_first(words: DataFrame, freq: DataFrame, key: str) -> DataFrame:
    """Per key its words in ascending (frequency, word); words without a frequency are dropped.
    ``words``: key, word."""
    ranked = attach_by_key(words, freq, "word", "freq").where(F.col("freq").isNotNull())
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("freq", "word"))), lambda x: x["word"]).alias("_order"))


def _postings(sets: DataFrame, ordered: DataFrame, k: int) -> DataFrame:
    """(word, set_key) of the sets that a search by the word has to look at.

    Of the sets that hold the same words from ``word`` on (in the common order, rarest first), those
    not found by a rarer word share equally much with any probe.  So only the ``k`` with the smallest
    keys matter, and a word held by every set has ``k`` postings, not one for every set."""
    listed = (sets.select("set_key", "_m").join(ordered, "set_key")
              .select("set_key", "_m", "_order", F.posexplode("_order").alias("_at", "word")))
    tail = F.sha2(F.array_join(F.slice("_order", F.col("_at") + 1, F.size("_order")), " "), 256)
    return top_per_key(listed.select("word", tail.alias("_tail"), "_m", "set_key"), ["word", "_tail"], ["_m", "set_key"], k).select("word", "set_key")


def similar_items(items: DataFrame, key, words: Column, probes: DataFrame, probe_key, k: int,
                  available: Column | None = None) -> DataFrame:
    """For each probe the k items sharing most words with it (ties: smallest key).

    Items with equal word sets are handled as one set holding its k + 1 smallest keys, so a group of
    copies never produces all its pairs.  An index of words is read rarest first, its lists cut where
    nothing behind the cut can win (see ``_postings``).  The first half of a probe's words gives a
    bound, its (k + 1)-th best score; of the other, commoner words only those are read behind which
    a set not yet found could still reach it."""
    tagged = items.withColumn("_words", F.sort_array(F.array_distinct(words)))
    pool = tagged if available is None else tagged.where(available)
    members = materialise(top_per_key(pool.select(F.col(key).alias("_id"), F.array_join("_words", " ").alias("set_key"),
                                                  "_words"), ["set_key"], ["_id"], k + 1), "members")
    sets = members.groupBy("set_key").agg(F.first("_words").alias("_words"), F.min("_id").alias("_m"))
    held = sets.select("set_key", F.explode("_words").alias("word"))
    freq = materialise(held.groupBy("word").agg(F.count(F.lit(1)).alias("freq")), "words")
    index = materialise(_postings(sets, _rarest_first(held, freq, "set_key"), k + 1), "postings")
    wanted = tagged.join(probes.select(F.col(probe_key).alias(key)).distinct(), key, "left_semi")
    asked = wanted.select(F.col(key).alias("probe"), F.explode("_words").alias("word"))
    asked = materialise(_rarest_first(asked, freq, "probe"), "probes")
    listed = asked.select("probe", F.size("_order").alias("_n"), F.posexplode("_order").alias("_at", "word"))
    first_half = F.col("_at") < F.col("_n") / 2

    def scored(some: DataFrame) -> DataFrame:
        pairs = some.join(index, "word").select("probe", "set_key").distinct()
        shared = F.size(F.array_intersect("_order", "_words"))
        return (pairs.join(asked.select("probe", "_order"), "probe").join(sets, "set_key")
                .select("probe", "set_key", "_m", shared.alias("common")))
    early = materialise(scored(listed.where(first_half)), "scores")
    best = [F.col("common").desc(), "_m"]
    bound = (top_per_key(early, ["probe"], best, k + 1, rank="place").where(F.col("place") == k + 1)
             .select("probe", F.col("common").alias("_bound")))
    late = (listed.where(~first_half).join(bound, "probe", "left")
            .where(F.col("_n") - F.col("_at") >= F.coalesce("_bound", F.lit(0))).select("probe", "word"))
    overlap = early.unionByName(scored(late)).dropDuplicates(["probe", "set_key"])
    # k + 1 best sets suffice: each holds at least one item
    best_sets = top_per_key(overlap, ["probe"], best, k + 1)
    ranked = best_sets.join(members.select("set_key", "_id"), "set_key").where(F.col("_id") != F.col("probe"))
    return (top_per_key(ranked, ["probe"], [F.col("common").desc(), "_id"], k, rank="place")
            .select("probe", F.col("_id").alias("similar"), "common", "place"))
