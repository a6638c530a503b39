"""Greedy choice against a plain loop, hot groups, ranks, rotation."""

import random

from pyspark.sql import functions as F

from shelfspark.operators import keyed, selection


def greedy(rows, budget, keys, stop_share=1.0):
    """rows: (group, order, price, *keys) in order per group."""
    out, left, owned = set(), {}, {}
    for group, order, price, *values in sorted(rows, key=lambda r: (r[0], r[1])):
        cents, whole = round(price * 100), round(budget * 100)
        money = left.setdefault(group, whole)
        mine = owned.setdefault(group, set())
        if whole - money >= round(whole * stop_share):
            continue
        tags = {(n, v) for n, v in enumerate(values) if v is not None} if keys else set()
        if tags & mine or cents > money:
            continue
        left[group] = money - cents
        mine |= tags
        out.add((group, order))
    return out


def test_budget_without_keys(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), i, rnd.randint(1, 30) + rnd.choice((0.0, 0.5))) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, price double")
    got = {(r.g, r.o) for r in selection.budget_select(df, "g", "price", ["o"], 200.0).collect()}
    assert got == greedy(rows, 200.0, False)


def test_budget_with_keys_and_many_repeats(spark):
    rnd = random.Random(2)
    # a third of the rows share one title, so that places of a price are used up
    rows = [("g", i, float(rnd.choice((5, 7, 11))), rnd.choice(("hot", "hot", f"t{i}", f"t{i % 40}")),
             None if i % 9 == 0 else f"s{rnd.randint(0, 60)}") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, price double, k1 string, k2 string")
    for share in (1.0, 0.9):
        got = {(r.g, r.o) for r in selection.budget_select(df, "g", "price", ["o"], 160.0, ("k1", "k2"), share).collect()}
        assert got == greedy(rows, 160.0, True, share)


def test_budget_never_exceeded(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), "id", (1 + F.col("id") % 17 + 0.25).alias("price"))
    total = selection.budget_select(df, "g", "price", ["id"], 99.0).groupBy("g").agg(F.sum("price").alias("s"))
    assert all(r.s <= 99.0 for r in total.collect())


def test_exact_rank_on_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                  (F.col("id") * 7919 % 3001).alias("o"))
    got = {(r.k, r.o): r.rank for r in keyed.exact_rank(df, ["k"], ["o"]).collect()}
    hot = sorted(o for k, o in got if k == "hot")
    assert [got[("hot", o)] for o in hot] == list(range(1, len(hot) + 1))
    assert all(v == 1 for (k, _), v in got.items() if k != "hot")


def test_top_per_key_with_a_limit_column(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("k"), "id", (F.col("id") % 4 + 2).cast("int").alias("n"))
    got = keyed.top_per_key(df, ["k"], ["id"], F.col("n")).groupBy("k").agg(F.count("*").alias("c"), F.max("id").alias("m"))
    assert {(r.k, r.c, r.m) for r in got.collect()} == {(k, k + 2, k + 4 * (k + 1)) for k in range(4)}


def test_attach_by_key_keeps_every_row(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 700).alias("k"))
    per_key = df.where("k < 650").groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("m"))
    got = keyed.attach_by_key(df, per_key, "k", "w")
    want = df.join(per_key, "k", "left").select("id", "k", "w", "m")
    assert got.count() == 5000 and got.exceptAll(want).count() == 0


def test_rotation_wraps_once(spark):
    lists = spark.createDataFrame([("youth", i) for i in range(3)] + [("other", i) for i in range(20)], "family string, i int")
    out = selection.rotating_quota(lists, "family", ["i"], 2, {"youth": 7}, 14, "other").collect()
    youth = sorted((r.slot, r.i) for r in out if r.family == "youth")
    # 7 of 3 lists laid twice from place (2 * 7) mod 3 = 2: four entries remain
    assert [i for _, i in youth] == [2, 0, 1, 2]
    other = sorted((r.slot, r.i) for r in out if r.family == "other")
    assert [i for _, i in other] == [(2 * 8 + k) % 20 for k in range(8)]
