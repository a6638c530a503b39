"""Collocations: the phrases of two to five words with the highest scores, per language.

Texts (A-Z lowered) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words.  ``f`` counts
contiguous occurrences within pieces, ``n`` all words of a language.  A phrase found ``a`` times,
cut into parts found ``l`` and ``r`` times, scores floor(1000 a n / (l r)); its lowest cut counts.

Method: best-first branch and bound.  As ``a`` never exceeds the count of the rest behind a prefix,
nothing grown from a prefix that begins with word w scores more than floor(1000 n / f(w)), and the
same holds for the last word.  Rare words thus head the frontier.  A round expands the words of
the next best bounds, level by level: phrases that begin or end with such a word are counted if
the parts already counted are frequent.  A phrase is settled once both its end words are expanded
(then its parts and all its one-word extensions are counted as well).  The frontier of a language
ends where the best bound left is below the score at the wanted place, ties included.

Bound on what meets in one place: per-task counts of blocks are summed by key; sets of frequent
phrases and frontier words reach the tasks as bit tables of a fixed size, which let through more
when they fill up, never less; everything exact is a join.  Words travel as 64-bit digests, checked
to be free of collisions (else taken anew with another salt).

Cases: null text counts as empty, null language as ``und``; empty tables give no rows; repeated
rows count each; null ids do not matter, as ids are not read; equal scores are ordered by count,
then by phrase in byte order; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import LOWERED, Stored, Words, blocks, mix64, powers, query, release, runs, table, text_bytes
from shelfspark.operators.keyed import top_per_key

LEAST, LONGEST, PLACES = 100, 5, 2000
SHARES = (1 / 16, 1 / 4, 1.0)   # share of the frequent word mass that a round's frontier reaches up to
STEP = 1.25                     # frontiers end at frequencies LEAST * STEP ** j, so that their choice is a small table
SLOTS = 1 << 22                 # entries of a table of word flags (one byte each)
BITS = 1 << 24                  # bits of a set of frequent phrases
TOGETHER = 1 << 20              # words counted together in a task

BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
KIND = ~BREAKS
KIND[[0x20, 0x09]] = False


# --- words ---------------------------------------------------------------------------------------

def _coded(batch: pa.RecordBatch, salt: int):
    """Per block of texts: lower-case bytes, words, their digests (the language is part of them),
    and whether a word begins a piece."""
    langs = batch.column("lang").cast(pa.string()).fill_null("und").dictionary_encode()
    seeds = np.array([int.from_bytes(np.uint64(len(x)).tobytes(), "little") ^ _text_digest(x) for x in langs.dictionary.to_pylist()], np.uint64)
    of_row = langs.indices.to_numpy(zero_copy_only=False)
    data, offsets = text_bytes(batch.column("text"))
    for i, j in blocks(offsets):
        part, ends = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        words = Words(part, ends, KIND)
        digest = words.hash
        if salt:
            up, _ = powers(len(part) + 1)
            np.cumsum(mix64(LOWERED + np.uint64(salt))[part] * up[:len(part)], out=words._total[1:])
            digest = words.upto(words.end)
        rows = of_row[i:j][words.doc]
        code = mix64(digest ^ seeds[rows]).view(np.int64) if len(rows) else np.zeros(0, np.int64)
        code[code == 0] = 1     # zero marks breaks
        stops = np.concatenate([[0], np.cumsum(BREAKS[part])])
        new = np.ones(len(code), bool)
        new[1:] = (words.doc[1:] != words.doc[:-1]) | (stops[words.start[1:]] != stops[words.end[:-1]])
        yield part, words, code, rows, langs.dictionary, new


def _text_digest(text: str) -> int:
    data = np.frombuffer(text.encode() + b"\x00", np.uint8)
    return int(mix64(np.array([np.sum(LOWERED[data] * powers(len(data))[0], dtype=np.uint64)], np.uint64))[0])


def _counted_words(salt: int):
    def run(batches):
        for batch in batches:
            for part, words, code, rows, langs, _ in _coded(batch, salt):
                _, first, count = np.unique(code, return_index=True, return_counts=True)
                raw = part.tobytes()
                texts = [raw[a:b].lower() for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(rows[first])), pa.array(code[first]), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(count)],
                    ["lang", "code", "word", "n"])
        release()
    return run


def vocabulary(docs: DataFrame) -> tuple[Stored, int]:
    """(lang, code, word, f) of every word, and the salt under which no two share a code."""
    for salt in itertools.count():
        found = docs.mapInArrow(_counted_words(salt), "lang string, code long, word string, n long")
        words = Stored(found.groupBy("lang", "code", "word").agg(F.sum("n").alias("f")), "words")
        if words.read().groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return words, salt
        words.drop()


# --- tables of a fixed size ----------------------------------------------------------------------

def _flags(words: DataFrame) -> np.ndarray:
    """By slot of the code, whether any of the given words falls there."""
    slots = words.select(F.col("code").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).distinct().toArrow()
    out = np.zeros(SLOTS, bool)
    out[slots.column("slot").to_numpy()] = True
    return out


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys & np.uint64(bits - 1)).astype(np.int64), ((keys >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _phrase_keys(codes: np.ndarray, m: int) -> np.ndarray:
    return runs(codes.view(np.uint64), m)


def _set_bits(m: int, bits: int):
    def run(batches):
        for batch in batches:
            flat = np.column_stack([batch.column(f"w{i}").to_numpy() for i in range(1, m + 1)]).reshape(-1)
            keys = _phrase_keys(np.ascontiguousarray(flat), m)[::m]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(keys, bits)).astype(np.int32))], ["bit"])
    return run


def _bits(phrases: DataFrame, m: int) -> np.ndarray:
    """A bit table that knows every given phrase of m words (and lets others through at times)."""
    found = phrases.mapInArrow(_set_bits(m, BITS), "bit int").distinct().toArrow()
    out = np.zeros(BITS, bool)
    out[found.column("bit").to_numpy()] = True
    return np.packbits(out, bitorder="little")


def _in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = _places(keys, 8 * len(bits))
    return ((bits[one >> 3] >> (one & 7).astype(np.uint8)) & (bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)


# --- growth --------------------------------------------------------------------------------------

def _stream(salt: int, frequent):
    """The texts as codes of frequent words, with a zero where a piece or the run of them ends;
    words without a neighbour are left out."""
    def run(batches):
        known = frequent.value
        for batch in batches:
            for _, _, code, _, _, new in _coded(batch, salt):
                good = known[code & (len(known) - 1)]
                linked = good[1:] & good[:-1] & ~new[1:]        # word i + 1 continues word i
                before, after = np.concatenate([[False], linked]), np.concatenate([linked, [False]])
                kept = np.flatnonzero(before | after)
                heads = ~before[kept]
                out = np.zeros(len(kept) + int(heads.sum()), np.int64)
                out[np.arange(len(kept)) + np.cumsum(heads)] = code[kept]
                for k in range(0, len(out), 1 << 13):       # rows of 64 KB, each with the words that a phrase may need beyond
                    yield pa.RecordBatch.from_arrays([pa.array([out[k:k + (1 << 13) + LONGEST - 1].tobytes()], pa.binary()),
                                                      pa.array([min(1 << 13, len(out) - k)], pa.int32())], ["codes", "n"])
        release()
    return run


def _count_level(m: int, frontier, earlier, shorter):
    """Counts of the phrases of m words that begin or end with a frontier word and did not so in an
    earlier round; of their parts one word shorter, those counted must be frequent."""
    def emit(held):
        now, past = frontier.value, earlier.value
        codes = np.concatenate([np.concatenate([x, np.zeros(LONGEST, np.int64)]) for x, _ in held])
        own = np.concatenate([np.arange(len(x) + LONGEST) < n for x, n in held])
        size = len(codes) - m + 1
        near, old = now[codes & (len(now) - 1)] & (codes != 0), past[codes & (len(now) - 1)] & (codes != 0)
        wanted = own[:size] & (near[:size] | near[m - 1:]) & ~(old[:size] | old[m - 1:])
        for i in range(m):
            wanted &= codes[i:size + i] != 0
        at = np.flatnonzero(wanted)
        if shorter is not None and len(at):
            keys = _phrase_keys(codes, m - 1)
            for begin in (at, at + 1):
                counted = near[begin] | near[begin + m - 2]
                at_ok = ~counted | _in_bits(shorter.value, keys[begin])
                wanted[at] &= at_ok
            at = np.flatnonzero(wanted)
        columns = [codes[at + i] for i in range(m)]
        key = columns[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for c in columns[1:]:
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c.view(np.uint64)
        order = np.argsort(key)
        columns = [c[order] for c in columns]
        edge = np.ones(len(order), bool)
        if len(order):
            edge[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, len(order)))
        return pa.RecordBatch.from_arrays([pa.array(c[first]) for c in columns] + [pa.array(count)], [f"w{i}" for i in range(1, m + 1)] + ["n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for raw, n in zip(batch.column("codes"), batch.column("n").to_pylist()):
                held.append((np.frombuffer(raw.as_buffer(), np.int64), n))
                size += n
                if size >= TOGETHER:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)
        release()
    return run


def _grown(stream: Stored, now, past, least: int, known: dict[int, list[Stored]]) -> None:
    """Counts one round's new phrases, level by level, and files the frequent ones in ``known``."""
    sc = stream.spark.sparkContext
    shorter = None
    for m in range(2, LONGEST + 1):
        names = [f"w{i}" for i in range(1, m + 1)]
        counted = stream.read().mapInArrow(_count_level(m, now, past, shorter), ", ".join(f"{w} long" for w in names) + ", n long")
        frequent = counted.groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        known[m].append(Stored(frequent, "phrases"))
        if shorter is not None:
            shorter.destroy()
        shorter = sc.broadcast(_bits(_all(known[m]), m)) if m < LONGEST else None


def _all(parts: list[Stored]) -> DataFrame:
    out = parts[0].read()
    for part in parts[1:]:
        out = out.unionAll(part.read())
    return out


def _listed(known: dict[int, list[Stored]]) -> DataFrame:
    """(p, f) of all frequent phrases counted so far."""
    out = None
    for m, parts in known.items():
        these = _all(parts).select(F.array(*[f"w{i}" for i in range(1, m + 1)]).alias("p"), "f")
        out = these if out is None else out.unionAll(these)
    return out


def _settled(longer: DataFrame, usual: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, p, a, k, l, r, n, score) of the surviving phrases whose end words are expanded."""
    head, tail = (lambda k: F.filter("p", lambda _, i: i < k)), (lambda k: F.filter("p", lambda _, i: i >= k))
    counts = usual.select(F.array("code").alias("p"), "f").unionAll(longer)
    # a phrase that a longer one accounts for entirely is covered by one of a single word more
    covers = (longer.where(F.size("p") > 2).select(F.explode(F.array(head(F.size("p") - 1), tail(1))).alias("p"), F.col("f").alias("a")).distinct())
    alive = longer.withColumnRenamed("f", "a").join(covers, ["p", "a"], "left_anti")
    # the language of a phrase is that of its first word
    tagged = (alive.withColumn("code", F.col("p")[0]).join(usual.select("code", "lang"), "code").drop("code")
              .join(facts.select("lang", "n", "reach"), "lang"))
    m = F.size("p")
    asked = (tagged.withColumn("k", F.explode(F.sequence(F.lit(1), m - 1)))
             .select("lang", "p", "a", "n", "reach", "k", head(F.col("k")).alias("left"), tail(F.col("k")).alias("right")))
    scored = (asked.join(counts.select(F.col("p").alias("left"), F.col("f").alias("l")), "left")
              .join(counts.select(F.col("p").alias("right"), F.col("f").alias("r")), "right")
              .withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)))"
                                          " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")))
    ends = F.greatest(F.max(F.when(F.col("k") == 1, F.col("l"))), F.max(F.when(F.col("k") == m - 1, F.col("r"))))
    cuts_of = F.sum(F.lit(1))
    return (scored.groupBy("lang", "p", "a", "n", "reach").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), ends.alias("ends"), cuts_of.alias("cuts"))
            .where((F.col("ends") <= F.col("reach")) & (F.col("cuts") == m - 1))
            .select("lang", "p", "a", "c.k", "c.l", "c.r", "n", "c.score"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, places: int = PLACES) -> DataFrame:
    """The first ``places`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    vocab, salt = vocabulary(docs)
    frequent = Stored(vocab.read().where(F.col("f") >= least), "frequent")
    usual = frequent.read()
    # frequent word mass by stretch of frequencies: a few dozen rows a language
    stretch = F.ceil(F.log(F.col("f") / least) / F.log(F.lit(STEP)) - 1e-9).cast("int")
    edge = F.floor(F.lit(least) * F.pow(F.lit(STEP), F.col("stretch")) + 1e-6).cast("long")
    mass = (usual.groupBy("lang", stretch.alias("stretch")).agg(F.sum("f").alias("mass"), F.max("f").alias("top"), F.min("f").alias("low"))
            .withColumn("reached", F.sum("mass").over(Window.partitionBy("lang").orderBy("stretch")) / F.sum("mass").over(Window.partitionBy("lang")))
            .withColumn("edge", F.greatest(edge, "top")).drop("mass"))
    totals = vocab.read().groupBy("lang").agg(F.sum("f").alias("n"))
    mass = Stored(mass.join(totals, "lang"), "stretches")
    vocab.drop()
    flags = spark.sparkContext.broadcast(_flags(usual))
    stream = Stored(docs.mapInArrow(_stream(salt, flags), "codes binary, n int"), "streams")
    flags.destroy()
    known: dict[int, list[Stored]] = {m: [] for m in range(2, LONGEST + 1)}
    past, old = np.zeros(SLOTS, bool), []
    floors: DataFrame | None = None
    for share in SHARES:
        # up to which frequency words are expanded: at least the first stretch, at most what the
        # score at the last place leaves open
        reach = (mass.read().groupBy("lang", "n").agg(F.max(F.when(F.col("reached") <= share + 1e-12, F.col("edge"))).alias("part"), F.min("edge").alias("one"))
                 .withColumn("reach", F.coalesce("part", "one")))
        if floors is not None:
            reach = (reach.join(floors, "lang", "left")
                     .withColumn("reach", F.greatest("before", F.least("reach", F.expr("1000 * n div greatest(floor, 1)")))))
        facts = Stored(reach.select("lang", "n", "reach"), "frontiers")
        now = past | _flags(usual.join(facts.read(), "lang").where(F.col("f") <= F.col("reach")))
        shared = [spark.sparkContext.broadcast(x) for x in (now, past)]
        _grown(stream, *shared, least, known)
        for x in shared:
            x.destroy()
        past = now
        phrases = Stored(_listed(known), "phrases")
        settled = Stored(_settled(phrases.read(), usual, facts.read()), "collocations")
        phrases.drop()
        # the score at the last place, where there are as many
        ranked = top_per_key(settled.read().select("lang", "score", "p"), ["lang"], [F.col("score").desc(), "p"], places, rank="place")
        last = ranked.where(F.col("place") == places).select("lang", F.col("score").alias("floor"))
        floors = Stored(facts.read().join(last, "lang", "left").select("lang", F.col("reach").alias("before"), F.coalesce("floor", F.lit(0)).alias("floor")), "floors")
        old += [facts, floors]
        # the best bound left: that of the rarest frequent word beyond the frontier
        beyond = usual.select("lang", "f").join(facts.read(), "lang").where(F.col("f") > F.col("reach")).groupBy("lang", "n").agg(F.min("f").alias("next"))
        open_ = beyond.join(floors.read(), "lang").where(F.expr("1000 * n div next") >= F.col("floor"))
        floors = floors.read()
        if open_.isEmpty():
            break
        settled.drop()
    best = settled.read().withColumn("tie", F.rank().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc()))).where(F.col("tie") <= places)
    spelled = (best.select("lang", "p", F.posexplode("p").alias("at", "code")).join(usual.select("code", "word"), "code")
               .groupBy("lang", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    result = Stored(top_per_key(best.join(spelled, ["lang", "p"]), ["lang"], [F.col("score").desc(), F.col("a").desc(), "phrase"], places, rank="rank")
                    .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "best")
    for stored in [frequent, mass, stream, settled, *old, *itertools.chain(*known.values())]:
        stored.drop()
    return result.read()


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang),
sized AS (SELECT lang, ws, unnest(range(1, 6)) AS m FROM words),
grams AS (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM sized WHERE len(ws) >= m),
counts AS (SELECT lang, ws[i:i + m - 1] AS p, m, count(*) AS f FROM grams GROUP BY ALL),
kept AS (SELECT lang, p, m, f FROM counts WHERE f >= {LEAST}),
covered AS (SELECT lang, p[1:m - 1] AS p, f FROM kept WHERE m > 2 UNION SELECT lang, p[2:m] AS p, f FROM kept WHERE m > 2),
alive AS (SELECT * FROM kept ANTI JOIN covered USING (lang, p, f) WHERE m > 1),
cuts AS (SELECT lang, p, m, f, unnest(range(1, m)) AS k FROM alive),
scored AS (SELECT c.lang, c.p, c.f AS a, c.k, l.f AS l, r.f AS r, n,
                  (1000::HUGEINT * c.f * n // (l.f::HUGEINT * r.f))::BIGINT AS score
           FROM cuts c JOIN kept l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN kept r ON r.lang = c.lang AND r.p = c.p[c.k + 1:c.m]
           JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase FROM lowest)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= {PLACES}
"""


@query("op11_collocations", SQL)
def op11_collocations(spark, folder):
    """The 2000 best phrases of every language of the documents."""
    return collocations(table(spark, folder, "documents"))
