"""Most similar items against a plain count; a word that every item holds."""

import random
import time

from pyspark.sql import functions as F

from shelfspark.operators import matching


def plain(rows, probes, k, available=lambda i: True):
    held = {i: set(w.split()) for i, w in rows}
    out = []
    for p in probes:
        found = sorted((-len(held[p] & w), i) for i, w in held.items() if i != p and available(i) and held[p] & w)
        out += [(p, i, -n, place) for place, (n, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_similar_items_equal_a_count(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    for k, common in ((3, ["le"]), (5, ["le", "la", "de"]), (1, [])):
        rows = [(i, " ".join(dict.fromkeys(common[:rnd.randint(0, 3)] + rnd.choices(words, [1 / (j + 1) for j in range(60)], k=rnd.randint(0, 7)))) or "seul")
                for i in range(400)]
        df = spark.createDataFrame(rows, "i long, t string")
        probes = [i for i, _ in rows[::7]]
        got = matching.similar_items(df, "i", F.split("t", " "), spark.createDataFrame([(p,) for p in probes], "p long"), "p", k, F.col("i") % 5 != 0)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, probes, k, lambda i: i % 5 != 0)


def test_a_word_of_every_item_has_few_postings(spark):
    """200,000 items hold 'tous' and 'deux', half of them 'mi'; a thousand probes find little else."""
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("i"), F.concat(F.lit("tous deux"), F.when(F.col("id") % 2 == 0, " mi").otherwise(""), F.lit(" x"), (F.col("id") / 4).cast("long").cast("string")).alias("t"))
    sets = df.select(F.sort_array(F.split("t", " ")).alias("_words"), F.col("i").alias("_m")).withColumn("set_key", F.array_join("_words", " "))
    sets = sets.groupBy("set_key").agg(F.first("_words").alias("_words"), F.min("_m").alias("_m"))
    held = sets.select("set_key", F.explode("_words").alias("word"))
    freq = held.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    index = matching._postings(sets, matching._rarest_first(held, freq, "set_key"), 4)
    sizes = {r.word: r["count"] for r in index.where("word in ('tous', 'deux', 'mi')").groupBy("word").count().collect()}
    assert sizes == {"tous": 4, "deux": 4, "mi": 4}
    probes = spark.range(0, n, 200).select(F.col("id").alias("p"))
    got = matching.similar_items(df, "i", F.split("t", " "), probes, "p", 3).orderBy("probe", "place").collect()
    assert len(got) == 3 * 1000
    by = {}
    for r in got:
        by.setdefault(r.probe, []).append((r.similar, r.common))
    assert by[200] == [(202, 4), (0, 3), (2, 3)] and by[0] == [(2, 4), (1, 3), (3, 3)]


def test_best_match_in_a_cell_equals_all_pairs(monkeypatch):
    """Common words as bits, rare ones through the index, few rights at once: the best of all pairs."""
    import pyarrow as pa
    monkeypatch.setattr(matching, "CELL_BITS", 64)
    monkeypatch.setattr(matching, "CELL_ROOM", 50)
    rnd = random.Random(9)

    def side(count):
        sets = [sorted(set(rnd.choices(range(150), [1 / (j + 1) for j in range(150)], k=rnd.randint(1, 25)))) for _ in range(count)]
        return sets, [len(s) + rnd.randint(0, 2) for s in sets]
    (a, na), (b, nb) = side(40), side(60)
    keys = rnd.sample(range(1000), 60)
    left = pa.table({"set_key": [bytes([i]) for i in range(40)], "n": pa.array(na, pa.int32()), "ids": pa.array(a, pa.list_(pa.int32())), "first": list(range(40))})
    right = pa.table({"set_key": [bytes([i]) for i in range(60)], "n": pa.array(nb, pa.int32()), "ids": pa.array(b, pa.list_(pa.int32())), "first": keys})
    for method, threshold in (("jaccard", 0.4), ("overlap", 0.5)):
        want = {}
        for i, x in enumerate(a):
            scored = []
            for j, y in enumerate(b):
                k = len(set(x) & set(y))
                score = k / (na[i] + nb[j] - k) if method == "jaccard" else k / max(na[i], nb[j])
                if score >= threshold:
                    scored.append((-score, keys[j]))
            if scored:
                want[bytes([i])] = (min(scored)[1], -min(scored)[0])
        got = matching._best_in_cell(threshold, method)(left, right).to_pylist()
        assert want and {r["set_key"]: (r["right_id"], r["score"]) for r in got} == want


def zipf_sets(seed, count, size, vocabulary):
    """Word sets as texts have them: common words in most, rare ones in few."""
    import numpy as np
    rnd = np.random.default_rng(seed)
    ids = np.minimum((np.exp(rnd.random((count, size)) * np.log(vocabulary))).astype(np.int64), vocabulary) + rnd.integers(0, 40, (count, size))
    return [sorted(set(row.tolist())) for row in ids]


def cell_side(sets):
    import pyarrow as pa
    return pa.table({"set_key": [i.to_bytes(4) for i in range(len(sets))], "n": pa.array([len(s) for s in sets], pa.int32()),
                     "ids": pa.array(sets, pa.list_(pa.int32())), "first": list(range(len(sets)))})


def test_pairs_that_share_common_words_are_not_counted_whole():
    """Of 81 million pairs one is similar; the others are not worth counting."""
    sets = zipf_sets(1, 18_000, 250, 300_000)
    left, right = sets[:9000], sets[9000:]
    right[77] = left[5][:-3] + [900_001]
    for method, threshold in (("jaccard", 0.6), ("overlap", 0.5)):
        begin = time.process_time()
        got = matching._best_in_cell(threshold, method)(cell_side(left), cell_side(right)).to_pylist()
        assert time.process_time() - begin < 2.5
        assert (5).to_bytes(4) in {r["set_key"] for r in got if r["right_id"] == 77}


def test_sets_of_many_equal_words_in_a_cell():
    """More words in common than a byte counts."""
    sets = zipf_sets(2, 6, 2500, 10 ** 6)
    left = sets + [s[: len(s) * 7 // 10] for s in sets]
    right = [s[len(s) // 10:] for s in sets] + sets[:2]
    for method, score in (("jaccard", lambda a, b: len(a & b) / len(a | b)), ("overlap", lambda a, b: len(a & b) / max(len(a), len(b)))):
        got = matching._best_in_cell(0.5, method)(cell_side(left), cell_side(right)).to_pylist()
        want = {}
        for i, a in enumerate(left):
            top = min((-score(set(a), set(b)), j) for j, b in enumerate(right))
            if -top[0] >= 0.5:
                want[i.to_bytes(4)] = (top[1], -top[0])
        assert want and {r["set_key"]: (r["right_id"], r["score"]) for r in got} == want


def test_blocks_are_stored_once_whatever_the_number_of_cells(spark, monkeypatch):
    """Small blocks make many cells; every set is in one stored row, and the matches are those of all pairs."""
    monkeypatch.setattr(matching, "CELL_WORDS", 150)
    monkeypatch.setattr(matching, "COMMON_WORDS", 30, raising=False)
    folders = []
    if hasattr(matching, "scratch"):
        scratch = matching.scratch
        monkeypatch.setattr(matching, "scratch", lambda *a: folders.append(scratch(*a)) or folders[-1])
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(120)]

    def texts(count):
        return [" ".join(rnd.choices(words, [1 / (j + 1) for j in range(120)], k=rnd.randint(1, 30))) for _ in range(count)]
    a, b = texts(60), texts(80) + ["nobody else knows"]
    b[3] = a[7]
    L, R = spark.createDataFrame(list(enumerate(a)), "id int, t string"), spark.createDataFrame(list(enumerate(b)), "id int, t string")
    for method, threshold in (("jaccard", 0.5), ("overlap", 0.4)):
        want = {}
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                x1, y1 = set(x.split()), set(y.split())
                s = len(x1 & y1) / (len(x1 | y1) if method == "jaccard" else max(len(x1), len(y1)))
                if s >= threshold and (i not in want or s > want[i][1]):
                    want[i] = (j, s)
        got = matching.fuzzy_title_match(L, "id", "t", R, "id", "t", threshold, method).collect()
        assert {r.left_id: (r.right_id, round(r.score, 9)) for r in got} == {k: (j, round(s, 9)) for k, (j, s) in want.items()}
        stored = spark.read.parquet(folders[-1])
        assert stored.select("block").distinct().count() > 12
        assert stored.count() == len({frozenset(t.split()) for t in a}) + len({frozenset(t.split()) for t in b[:-1]})
