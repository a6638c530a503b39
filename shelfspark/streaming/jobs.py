"""Recurring feeds as Structured Streaming queries.

Every writer takes an explicit checkpoint folder and uses the available-now
trigger by default, so the same job runs weekly or continuously.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators import footfall, suggestions
from shelfspark.sinks.exports import upsert


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


# --- increments and their rollup ------------------------------------------------------------

EVERY = 50      # batches after which what is stored is folded into one folder


def _folder(spark: SparkSession, table: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _stored_parts(spark: SparkSession, table: str) -> tuple[int, list[str], list[str]]:
    """(last batch that the newest finished rollup holds or -1, folders that count, folders that do not)."""
    fs, root = _folder(spark, table)
    found = {"batch": {}, "rollup": {}}
    for entry in fs.listStatus(root) if fs.exists(root) else ():
        kind, _, number = entry.getPath().getName().partition("=")
        if kind in found and number.isdigit():
            found[kind][int(number)] = f"{table.rstrip('/')}/{kind}={number}"
    finished = [n for n, path in found["rollup"].items() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))]
    last = max(finished, default=-1)
    counted = ([found["rollup"][last]] if last >= 0 else []) + [path for n, path in sorted(found["batch"].items()) if n > last]
    return last, counted, [p for kind in found.values() for p in kind.values() if p not in counted]


def stored(spark: SparkSession, table: str) -> DataFrame:
    """What the batches stored, each of them once: the newest rollup and the batches behind it."""
    _, counted, _ = _stored_parts(spark, table)
    return spark.read.parquet(*counted or [table])


def roll_up(spark: SparkSession, table: str, before: int, fold) -> None:
    """Folds the batches up to ``before`` into one folder, then removes what it holds.

    The name of a rollup is the last batch in it.  It counts once it is finished, and from then on
    the batches up to that one do not, so a failure at any point loses and doubles nothing; what it
    leaves behind goes with the next rollup."""
    last, counted, _ = _stored_parts(spark, table)
    held = [path for path in counted if "rollup=" in path or int(path.rpartition("=")[2]) <= before]
    if before > last and len(held) > 1:
        fold(spark.read.parquet(*held)).write.mode("overwrite").parquet(f"{table.rstrip('/')}/rollup={before}")
    fs, _ = _folder(spark, table)
    for path in _stored_parts(spark, table)[2]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def _increment(table: str, of, fold, every: int = EVERY):
    """Batch writer: what a batch adds goes to a folder of its own, so a batch run again replaces
    itself.  Every so often the batches before it are rolled up; the running one never is, so one
    that runs again is never part of a rollup."""
    def store(batch: DataFrame, number: int):
        of(batch).write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")
        if number % every == every - 1:
            roll_up(batch.sparkSession, table, number - 1, fold)
    return store


# --- visitor counters ---------------------------------------------------------------------

def hourly_windows(stream: DataFrame, ts, entries, lateness: str = "7 days") -> DataFrame:
    """Additive mode: event-time sums per hour with late rows admitted."""
    return (stream.where(F.col(entries) > 0).withWatermark(ts, lateness)
            .groupBy(F.window(ts, "1 hour").alias("slot"))
            .agg(F.sum(entries).alias("all_entries"),
                 F.sum(F.when(footfall.is_open(F.col(ts)), F.col(entries))).alias("open_entries")))


def stream_footfall(stream: DataFrame, ts, entries, table: str, checkpoint: str, file, once: bool = True) -> StreamingQuery:
    """Replace mode: a slot sent again in a later ``file`` replaces the earlier total.

    Each batch adds the sums per slot and file of its own rows, however the files
    are cut into batches; ``stored_footfall`` reads the table."""
    def increments(batch: DataFrame) -> DataFrame:
        seen = batch.where(F.col(entries) > 0)
        return (seen.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "HH:00").alias("hour"), F.col(file).alias("file"))
                .agg(F.sum(entries).alias("all_entries"), F.sum(F.when(footfall.is_open(F.col(ts)), F.col(entries))).alias("open_entries")))
    return _start(stream.writeStream.foreachBatch(_increment(table, increments, _per_file)), checkpoint, once)


def _per_file(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "hour", "file").agg(F.sum("all_entries").alias("all_entries"), F.sum("open_entries").alias("open_entries"))


def stored_footfall(spark: SparkSession, table: str) -> DataFrame:
    """Totals per slot: those of the last file (in the order of ``file``) that has it."""
    last = F.max(F.struct("file", "all_entries", "open_entries"))
    return _per_file(stored(spark, table)).groupBy("day", "hour").agg(last.alias("_l")).select("day", "hour", "_l.all_entries", "_l.open_entries")


# --- stock-take -----------------------------------------------------------------------------

def scan_counts(stream: DataFrame, code, day: Column) -> DataFrame:
    """Scans per code and day.  The dates of a code are rows, not a growing list."""
    return stream.groupBy(code, day.alias("day")).agg(F.count(F.lit(1)).alias("scans"))


def stream_stocktake(stream: DataFrame, code, day: Column, table: str, checkpoint: str,
                     once: bool = True) -> StreamingQuery:
    """Each batch adds its own counts; ``stored_scans`` reads the table."""
    return _start(stream.writeStream.foreachBatch(_increment(table, lambda batch: scan_counts(batch, code, day), lambda rows: _per_code(rows, code))), checkpoint, once)


def _per_code(rows: DataFrame, code) -> DataFrame:
    return rows.groupBy(code, "day").agg(F.sum("scans").alias("scans"))


def stored_scans(spark: SparkSession, table: str, code) -> DataFrame:
    return _per_code(stored(spark, table), code)


# --- status of suggestions ---------------------------------------------------------------------

def stream_latest_status(stream: DataFrame, key, action, at, tie, table: str, checkpoint: str,
                         once: bool = True) -> StreamingQuery:
    """Each batch adds the last action per key of its own rows; ``stored_status`` reads the table."""
    def latest(batch: DataFrame) -> DataFrame:
        last = F.max(F.struct(F.col(at).alias("since"), F.col(tie).alias("tie"), F.col(action).alias("status")))
        return batch.groupBy(key).agg(last.alias("last"))
    return _start(stream.writeStream.foreachBatch(_increment(table, latest, lambda rows: _latest(rows, key))), checkpoint, once)


def _latest(rows: DataFrame, key) -> DataFrame:
    return rows.groupBy(key).agg(F.max("last").alias("last"))


def stored_status(spark: SparkSession, table: str, key) -> DataFrame:
    return _latest(stored(spark, table), key).select(key, "last.status", "last.since")


# --- logs, repeats, work queues --------------------------------------------------------------------

def append_usage_log(stream: DataFrame, table: str, checkpoint: str, day: Column, once: bool = True) -> StreamingQuery:
    """One row per question, partitioned by day."""
    dated = stream.withColumn("log_day", day)
    return _start(dated.writeStream.outputMode("append").format("parquet").partitionBy("log_day").option("path", table),
                  checkpoint, once)


def distinct_within(stream: DataFrame, ts, columns, lateness: str = "35 days") -> DataFrame:
    """Titles listed again within the lateness are dropped."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(columns))


def stream_suggestions(stream: DataFrame, title, position, table: str, checkpoint: str,
                       once: bool = True) -> StreamingQuery:
    """Appends the titles of each batch that were never stored."""
    def store(batch: DataFrame, _):
        spark: SparkSession = batch.sparkSession
        empty = spark.createDataFrame([], "title_key string")
        try:
            stored = spark.read.parquet(table).select("title_key")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            stored = empty
        suggestions.dedup_suggestions(batch, stored, title, position).write.mode("append").parquet(table)
    return _start(stream.writeStream.foreachBatch(store), checkpoint, once)


def campaign_batch(spark: SparkSession, pending: DataFrame, tried_table: str, key, n: int = 200) -> DataFrame:
    """Next n keys of a campaign, recorded as tried so that each comes once."""
    from shelfspark.session import materialise
    try:
        tried = spark.read.parquet(tried_table)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        tried = pending.select(key).limit(0)
    batch = materialise(suggestions.next_batch(pending, tried, key, n), "campaign")
    batch.select(key).write.mode("append").parquet(tried_table)
    return batch


def record_freshness(spark: SparkSession, incoming: DataFrame, table: str) -> DataFrame:
    """Compare feed dates with those of the last import, then store them."""
    from shelfspark.session import materialise
    try:
        state = spark.read.parquet(table)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        state = incoming.select("feed", "file_date").limit(0)
    verdict = materialise(suggestions.feed_freshness(state, incoming), "freshness")
    upsert(spark, table, verdict.where(F.col("file_date").isNotNull()).select("feed", "file_date"),
           "feed", ["file_date"])
    return verdict
