"""Rollup of stored batches: few folders, every batch once, also after failures and reruns."""

import os
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.streaming import jobs as streams


def counts(rows):
    out = {}
    for code, n in rows:
        out[code] = out.get(code, 0) + n
    return out


def batch(spark, rows):
    return spark.createDataFrame(rows, "code string, scans long").withColumn("day", F.lit("2026-01-01"))


def fold(rows):
    return rows.groupBy("code", "day").agg(F.sum("scans").alias("scans"))


def read(spark, table):
    return {r.code: r.scans for r in streams.stored_scans(spark, table, "code").collect()}


def test_many_batches_leave_few_folders(spark, tmp_path):
    table, rnd, every = str(tmp_path / "t"), random.Random(1), []
    store = streams._increment(table, lambda b: b, fold, every=8)
    for number in range(35):
        rows = [(rnd.choice("abc"), rnd.randint(1, 5)) for _ in range(rnd.randint(0, 3))]
        store(batch(spark, rows), number)
        if number in (3, 7, 8, 20):        # the last batch runs again, as after a failure
            store(batch(spark, rows), number)
        every += rows
        if number % 9 == 0:
            assert read(spark, table) == counts(every)
    assert read(spark, table) == counts(every)
    assert len([f for f in os.listdir(table) if "=" in f]) <= 9


class Lost(Exception):
    pass


def test_a_failure_at_any_step_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    rows = [[("a", 1)], [("b", 2)], [("a", 3)], [("c", 4)]]
    for step in ("fold", "delete"):
        table = str(tmp_path / step)
        for number, some in enumerate(rows):
            streams._increment(table, lambda b: b, fold, every=100)(batch(spark, some), number)
        want = counts([r for some in rows for r in some])

        def broken(frame):
            raise Lost
        if step == "fold":
            with pytest.raises(Lost):
                streams.roll_up(spark, table, 2, broken)
        else:
            folder = streams._folder

            def lost(spark_, table_):
                if len([f for f in os.listdir(table) if f.startswith("rollup=")]):
                    raise Lost      # the rollup is finished, nothing has been removed
                return folder(spark_, table_)
            monkeypatch.setattr(streams, "_folder", lost)
            with pytest.raises(Lost):
                streams.roll_up(spark, table, 2, fold)
            monkeypatch.setattr(streams, "_folder", folder)
        assert read(spark, table) == want
        os.makedirs(f"{table}/rollup=9", exist_ok=True)      # begun, never finished
        assert read(spark, table) == want
        streams.roll_up(spark, table, 2, fold)
        assert read(spark, table) == want and sorted(f for f in os.listdir(table) if "=" in f) == ["batch=3", "rollup=2"]
