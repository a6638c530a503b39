"""Visitor counters: hourly and daily series, all hours and opening hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.rules import is_open
from shelfspark.functions.vocab import OPENING_RULES


def counter_rows(df: DataFrame, date, clock, entries) -> DataFrame:
    """(ts, entries) of usable counter rows: an hour and a positive count."""
    ts = F.try_to_timestamp(F.concat_ws(" ", F.col(date), F.lpad(F.substring(F.col(clock), 1, 5), 5, "0")),
                            F.lit("yyyy-MM-dd HH:mm"))
    return (df.select(ts.alias("ts"), F.trim(F.col(entries)).try_cast("bigint").alias("entries"))
            .where((F.col("entries") > 0) & F.col("ts").isNotNull()))


def hourly(df: DataFrame, ts, entries) -> DataFrame:
    """Entries by day and hour: all of them, and within opening hours."""
    ts_col, n = F.col(ts), F.col(entries)
    return (df.where(n > 0)
            .groupBy(F.date_format(ts_col, "yyyy-MM-dd").alias("day"),
                     F.date_format(ts_col, "HH:00").alias("hour"))
            .agg(F.sum(n).alias("all_entries"),
                 F.sum(F.when(is_open(ts_col), n)).alias("open_entries")))


def daily(df: DataFrame, ts, entries) -> DataFrame:
    """Entries by day in both series; built on the hourly sums' grouping."""
    ts_col, n = F.col(ts), F.col(entries)
    return (df.where(n > 0).groupBy(F.date_format(ts_col, "yyyy-MM-dd").alias("day"))
            .agg(F.sum(n).alias("all_entries"), F.sum(F.when(is_open(ts_col), n)).alias("open_entries")))


def open_series(hours: DataFrame) -> DataFrame:
    """The opening-hours series alone (slots with no open entry are absent)."""
    return hours.where(F.col("open_entries").isNotNull()).drop("all_entries")


def day_reconciliation(days: DataFrame, hours: DataFrame, value="all_entries") -> DataFrame:
    """Days only in one table, and days whose totals differ."""
    d = days.select("day", F.col(value).alias("daily"))
    h = hours.groupBy("day").agg(F.sum(value).alias("hourly"))
    both = d.join(h, "day", "full")
    return (both.withColumn("problem", F.when(F.col("hourly").isNull(), "daily only")
                            .when(F.col("daily").isNull(), "hourly only")
                            .when(F.col("daily") != F.col("hourly"), "totals differ"))
            .where(F.col("problem").isNotNull()))


def opening_rules(spark: SparkSession) -> DataFrame:
    """The fixed opening rules, one row per rule and weekday (17 rows)."""
    rows = [(first, last, day, opens, closes, public)
            for first, last, days, opens, closes, public in OPENING_RULES for day in days]
    return spark.createDataFrame(rows, "first_month int, last_month int, weekday int, opens string, "
                                       "closes string, open_public boolean")


def open_hours_join(df: DataFrame, ts, rules: DataFrame) -> DataFrame:
    """Range join of counter rows with the (fixed, 17-row) rules table: equal on
    the weekday, between on month and clock."""
    clock, month = F.date_format(ts, "HH:mm"), F.month(ts)
    return df.withColumn("weekday", F.weekday(ts)).join(
        F.broadcast(rules),
        ["weekday"], "inner").where(
        month.between(F.col("first_month"), F.col("last_month"))
        & (clock >= F.col("opens")) & (clock < F.col("closes")))


def busiest_slot(hours: DataFrame, by: str = "day", value="all_entries") -> DataFrame:
    """Hour with the most entries per day or weekday (ties: earliest hour)."""
    key = F.col("day") if by == "day" else F.weekday(F.col("day").cast("date"))
    sums = hours.groupBy(key.alias(by), "hour").agg(F.sum(value).alias("entries"))
    best = F.max_by(F.struct("hour", "entries"),
                    F.struct("entries", (-F.substring("hour", 1, 2).cast("int")).alias("e")))
    return sums.groupBy(by).agg(best.alias("b")).select(by, "b.hour", "b.entries")


def yoy_by_weekday(df: DataFrame, date, value, first: int, second: int) -> DataFrame:
    """Two years aligned on (ISO week, weekday): one pass, both years side by
    side, days open in each and sums."""
    d = F.col(date)
    year = F.extract(F.lit("YEAROFWEEK"), d)
    days = (df.where(year.isin(first, second))
            .groupBy(F.weekofyear(d).alias("week"), F.weekday(d).alias("weekday"))
            .agg(F.sum(F.when(year == first, F.col(value))).alias("first_total"),
                 F.sum(F.when(year == second, F.col(value))).alias("second_total")))
    return days.where(F.col("first_total").isNotNull() & F.col("second_total").isNotNull())


def footfall_profile(days: DataFrame, date="day", value="all_entries", ceiling: int = 3000) -> DataFrame:
    """Per year: days, entries, extremes, days with no, or too many, entries."""
    v = F.col(value)
    return (days.groupBy(F.substring(date, 1, 4).alias("year"))
            .agg(F.count(F.lit(1)).alias("days"), F.sum(v).alias("entries"),
                 F.min(date).alias("first_day"), F.max(date).alias("last_day"),
                 F.sum(F.when(v.isNull() | (v <= 0), 1).otherwise(0)).alias("no_entries"),
                 F.sum(F.when(v > ceiling, 1).otherwise(0)).alias("too_many"),
                 F.sum(F.when(F.weekday(F.col(date).cast("date")) == 6, 1).otherwise(0)).alias("sundays")))


def date_formats(df: DataFrame, date) -> DataFrame:
    """How dates are written: ISO, French, other."""
    c = F.col(date)
    shape = (F.when(c.rlike("^\\d{4}-\\d{2}-\\d{2}$"), "yyyy-mm-dd")
             .when(c.rlike("^\\d{2}/\\d{2}/\\d{4}$"), "dd/mm/yyyy").otherwise("other"))
    return df.groupBy(shape.alias("format")).agg(F.count(F.lit(1)).alias("n"))


def counter_issues(rows: DataFrame, ts, value, days: int = 5) -> dict[str, DataFrame]:
    """What to look at in a counter export: readings given twice, the busiest days, and entries by
    hour outside the opening hours."""
    seen = rows.where(F.col(value) > 0)
    per_day = seen.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.sum(value).alias("entries"))
    return {
        "duplicates": rows.groupBy(ts).agg(F.count(F.lit(1)).alias("readings")).where("readings > 1"),
        "top_days": per_day.orderBy(F.col("entries").desc(), "day").limit(days),
        "off_hours": (seen.where(~is_open(F.col(ts))).groupBy(F.date_format(ts, "HH:00").alias("hour"))
                      .agg(F.sum(value).alias("entries"), F.count(F.lit(1)).alias("readings"))),
    }
