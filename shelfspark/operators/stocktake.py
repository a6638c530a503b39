"""Comparing scans with the stock, zone by zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_scans(stock: DataFrame, scans: DataFrame, code) -> DataFrame:
    return stock.join(scans.select(code).distinct(), code, "left_semi")


def stock_missing(stock: DataFrame, scans: DataFrame, code, zone) -> DataFrame:
    """Expected in a zone under way and never scanned."""
    zones = known_scans(stock, scans, code).select(zone).distinct()
    return (stock.join(zones, zone, "left_semi")
            .join(scans.select(code), code, "left_anti"))


def unknown_codes(scans: DataFrame, stock: DataFrame, code) -> DataFrame:
    return scans.select(code).distinct().join(stock.select(code), code, "left_anti")


def zone_progress(stock: DataFrame, scans: DataFrame, code, zone) -> DataFrame:
    """Expected, seen, missing, percentage of the zones under way."""
    seen = scans.select(code).distinct().withColumn("_seen", F.lit(1))
    return (stock.join(seen, code, "left").groupBy(zone)
            .agg(F.count(F.lit(1)).alias("expected"), F.count("_seen").alias("seen"))
            .where(F.col("seen") > 0)
            .withColumn("missing", F.col("expected") - F.col("seen"))
            .withColumn("percent", F.round(100.0 * F.col("seen") / F.col("expected"), 1)))


def scan_delta(scans: DataFrame, memory: DataFrame, code, today: str) -> DataFrame:
    """New memory rows after a cumulative scan file: (code, n, dates).

    Only occurrences beyond those already counted add a date; ``status`` tells
    first scans from codes seen again.  The dates added are written as one
    ``date x times`` pair, so a code scanned a million times stays one row."""
    now = scans.groupBy(code).agg(F.count(F.lit(1)).alias("_now"))
    both = now.join(memory.select(code, F.col("n").alias("_known"), "dates"), code, "full")
    known, current = F.coalesce("_known", F.lit(0)), F.coalesce("_now", F.lit(0))
    extra = F.greatest(current - known, F.lit(0))
    added = F.when(extra > 0, F.array(F.struct(F.lit(today).alias("date"), extra.alias("times"))))
    return both.select(
        code, F.greatest(current, known).alias("n"),
        F.concat(F.coalesce("dates", F.array().cast("array<struct<date:string,times:bigint>>")),
                 F.coalesce(added, F.array().cast("array<struct<date:string,times:bigint>>"))).alias("dates"),
        F.when(extra == 0, "unchanged").when(known == 0, "new").otherwise("seen again").alias("status"))


def read_memory(lines: DataFrame, line="value") -> DataFrame:
    """Scan memory ``code<TAB>n<TAB>d1;d2``; the older ``code<TAB>date`` counts one."""
    parts = F.split(F.col(line), "\t")
    usable = lines.where(~F.ltrim(line).startswith("#") & (F.trim(line) != ""))
    older = F.size(parts) == 2
    dates = F.when(F.size(parts) >= 3, F.filter(F.split(F.get(parts, F.lit(2)), ";"), lambda d: d != "")) \
        .when(older, F.array(F.get(parts, F.lit(1)))).otherwise(F.array(F.lit("?")))
    return usable.select(
        F.get(parts, F.lit(0)).alias("code"),
        F.when(F.size(parts) >= 3, F.get(parts, F.lit(1)).try_cast("bigint")).otherwise(F.lit(1)).alias("n"),
        F.transform(F.array_distinct(dates), lambda d: F.struct(
            d.alias("date"), F.size(F.filter(dates, lambda x: x == d)).cast("bigint").alias("times"))).alias("dates"))
