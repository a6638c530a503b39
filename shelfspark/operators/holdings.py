"""Questions about titles, copies, series and loans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.rules import dewey_class, period_bucket
from shelfspark.functions.text import author_first, col, filled, fold_text, leading_int
from shelfspark.operators.keyed import top_per_key

CHUNK = 1000   # volume numbers looked at, or generated, together


def ratio(total, n, digits: int = 1) -> Column:
    return F.round(col(total).cast("double") / col(n), digits)


def present(df: DataFrame, column: str) -> Column:
    """Has a value; only text is searched for blanks, so that the test on other
    types reaches the scan."""
    c = F.col(column)
    return filled(c) if isinstance(df.schema[column].dataType, T.StringType) else c.isNotNull()


def volume_number(df: DataFrame, column: str) -> Column:
    """The volume as a number: parsed from text, plain for numeric columns."""
    c = F.col(column)
    return leading_int(c) if isinstance(df.schema[column].dataType, T.StringType) else c.cast("bigint")


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """ORDER BY ... LIMIT k; the order should end in a unique key."""
    return df.orderBy(*order).limit(k)


# --- loans by creator, title, group -----------------------------------------------------

def top_creators(df, creator, title, loans, min_total=15, k: int | None = 25) -> DataFrame:
    """Distinct titles, loans and loans per title of each creator."""
    # (creator, title) first: the distinct count is then a plain count and a
    # hot creator is pre-aggregated on the map side.
    per_title = (df.where(present(df, creator) & (F.col(loans) > 0))
                 .groupBy(creator, title).agg(F.sum(loans).alias("_loans")))
    out = (per_title.groupBy(creator)
           .agg(F.count(F.lit(1)).alias("titles"), F.sum("_loans").alias("total_loans"))
           .where(F.col("total_loans") >= min_total)
           .withColumn("loans_per_title", ratio("total_loans", "titles")))
    return top_k(out, [F.col("total_loans").desc(), creator], k) if k else out


def single_copy_hot(titles, copies, key, copy_loans, min_loans=12, k: int | None = 20) -> DataFrame:
    """Titles with exactly one copy lent at least ``min_loans`` times."""
    # The copies are reduced to one row per title before meeting the titles.
    per_title = (copies.groupBy(key)
                 .agg(F.count(F.lit(1)).alias("copies"), F.sum(copy_loans).alias("total_loans"))
                 .where((F.col("copies") == 1) & (F.col("total_loans") >= min_loans)))
    out = titles.join(per_title, key)
    return top_k(out, [F.col("total_loans").desc(), key], k) if k else out


def rotation(df, keys, title, loans, min_titles=1, only_lent=False, by_rows=False,
             k: int | None = None) -> DataFrame:
    """Titles, loans and loans per title of each group."""
    for key in keys[:1]:
        df = df.where(present(df, key))
    if only_lent:
        df = df.where(F.col(loans) > 0)
    if by_rows:
        out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("titles"),
                                    F.sum(loans).alias("total_loans"))
    else:
        per_title = df.groupBy(*keys, title).agg(F.sum(loans).alias("_loans"))
        out = per_title.groupBy(*keys).agg(F.count(F.lit(1)).alias("titles"),
                                           F.sum("_loans").alias("total_loans"))
    out = (out.where(F.col("titles") >= min_titles)
           .withColumn("rotation", ratio("total_loans", "titles")))
    return top_k(out, [F.col("rotation").desc(), *keys], k) if k else out


def recent_low_use(df, published, loans, since: int, below, key, k: int = 30,
                   lexicographic: bool = False) -> DataFrame:
    """Recent titles with few loans, newest first.

    ``lexicographic`` compares the raw text, so that ``DL 2026`` counts as
    recent; by default the parsed year is compared.
    """
    text = F.col(published).cast("string")
    year = F.substring(text, 1, 4) if lexicographic else F.regexp_extract(
        text, "((?:19|20)\\d{2})", 1)
    recent = df.where((year >= str(since)) & (F.col(loans) < below))
    return top_k(recent, [F.col(published).desc(), F.col(loans), key], k)


def never_lent(df, loans) -> DataFrame:
    return df.where(F.col(loans) == 0)


def loans_below(df, loans, n) -> DataFrame:
    return df.where(F.coalesce(F.col(loans), F.lit(0)) < n)


def age_profile(df, published, loans) -> DataFrame:
    """Titles, loans and rotation per publication period."""
    return (df.where(present(df, published))
            .groupBy(period_bucket(F.substring(F.col(published).cast("string"), 1, 4)).alias("period"))
            .agg(F.count(F.lit(1)).alias("titles"), F.sum(loans).alias("total_loans"))
            .withColumn("rotation", ratio("total_loans", "titles")))


def smallest_classes(df, dewey, loans, k: int = 10) -> DataFrame:
    """The least represented classes."""
    out = (df.where(present(df, dewey))
           .groupBy(dewey_class(dewey).alias("class"))
           .agg(F.count(F.lit(1)).alias("titles"), F.sum(loans).alias("total_loans")))
    return top_k(out, ["titles", "class"], k)


def top_series(view, series, title_loans, k: int = 5) -> DataFrame:
    """Loans per series at copy grain: a title's loans count once per copy."""
    out = (view.where(present(view, series)).groupBy(series)
           .agg(F.sum(title_loans).alias("total_loans")))
    return top_k(out, [F.col("total_loans").desc(), series], k)


def availability(df, keys, status: Column) -> DataFrame:
    """Copies per title, of which on loan and lendable."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"),
                                F.sum(F.when(status, 1).otherwise(0)).alias("on_loan"))
    return out.withColumn("lendable", F.col("copies") - F.col("on_loan"))


def loan_delta(df, key, date, total) -> DataFrame:
    """Loans since the previous snapshot.  The snapshots are first reduced to
    one row per (key, date); a key then has as many rows as there are exports."""
    snapshots = df.groupBy(key, date).agg(F.sum(total).alias("total_loans"))
    before = F.lag("total_loans").over(Window.partitionBy(key).orderBy(date))
    return snapshots.withColumn("delta", F.col("total_loans") - before)


# --- series and their volumes ---------------------------------------------------------------

def numbered(df, series, volume) -> DataFrame:
    """Rows with a series and a volume starting with a digit."""
    text = isinstance(df.schema[volume].dataType, T.StringType)
    usable = F.col(volume).rlike("^[0-9]") if text else F.col(volume) >= 0
    return df.where(present(df, series) & usable)


def series_volumes(df, series, volume, loans=None) -> DataFrame:
    """One row per (series, volume label): label, number, loans."""
    total = F.sum(loans) if loans else F.lit(0)
    return (numbered(df, series, volume).groupBy(series, volume).agg(total.alias("loans"))
            .select(series, F.col(volume).cast("string").alias("volume"), "loans",
                    volume_number(df, volume).alias("number")))


def series_gaps(df, series, volume, loans, min_loans=5, k: int | None = None) -> DataFrame:
    """Series holding fewer distinct volumes than their highest number."""
    out = (series_volumes(df, series, volume, loans).groupBy(series)
           .agg(F.count(F.lit(1)).alias("volumes_held"), F.max("number").alias("highest"),
                F.sum("loans").alias("total_loans"))
           .where((F.col("volumes_held") < F.col("highest")) & (F.col("highest") > 1)
                  & (F.col("total_loans") >= min_loans)))
    return top_k(out, [F.col("total_loans").desc(), series], k) if k else out


def series_gap_volumes(df, series, volume, loans, min_loans=5) -> DataFrame:
    """The volumes held by the series with gaps, one row each: the listing that
    goes with ``series_gaps`` without building a list per series."""
    gaps = series_gaps(df, series, volume, loans, min_loans).select(series)
    return series_volumes(df, series, volume).select(series, "volume").join(gaps, series, "left_semi")


def listed_volumes(df, series, volume, loans, min_loans=5, numbers: int = 500) -> DataFrame:
    """``series_gaps`` with the volume labels as texts, complete however long a series is.

    A text lists the volumes of ``numbers`` consecutive numbers; ``part`` counts
    these stretches from 0, and a series has a row for each that holds a volume.
    """
    held = series_volumes(df, series, volume, loans)
    gaps = series_gaps(df, series, volume, loans, min_loans)
    texts = (held.withColumn("part", F.floor(F.col("number") / numbers)).groupBy(series, "part")
             .agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct("number", "volume"))),
                 lambda v: v["volume"]), ",").alias("volumes")))
    return gaps.join(texts, series)


def series_gaps_simple(df, series, volume, k: int = 5) -> DataFrame:
    """Row count against highest number, widest gap first."""
    out = (numbered(df, series, volume).groupBy(series)
           .agg(F.count(F.lit(1)).alias("records"),
                F.max(volume_number(df, volume)).alias("highest"))
           .withColumn("gap", F.col("highest") - F.col("records"))
           .where(F.col("gap") > 0))
    return top_k(out, [F.col("gap").desc(), series], k)


def _volumes_known(df, series, volume, loans) -> DataFrame:
    """(series, number, _loans), numbers NULL where a row has none: its loans count for the series."""
    return (df.withColumn("number", volume_number(df, volume)).where(present(df, series))
            .groupBy(series, "number").agg(F.sum(loans).alias("_loans")))


def missing_ranges(df, series, volume, loans, min_held: int = 2) -> DataFrame:
    """Stretches of numbers between 1 and the highest volume that a series lacks: series, low, high,
    total_loans (rows without a number included).

    Gaps and islands: the number after each held one tells the gap behind it.  Numbers are first
    looked at within stretches of 1,000, then the stretches' ends, so neither a long series nor a
    mistyped volume of two billion is generated or gathered."""
    held = _volumes_known(df, series, volume, loans)
    known = (held.groupBy(series).agg(F.count("number").alias("_held"), F.sum("_loans").alias("total_loans"))
             .where(F.col("_held") >= min_held).drop("_held"))
    # every series begins at an imagined volume 0
    numbers = held.where(F.col("number") >= 1).select(series, "number")
    chunked = numbers.withColumn("_chunk", F.floor(F.col("number") / CHUNK))
    inner = Window.partitionBy(series, "_chunk").orderBy("number")
    within = chunked.select(series, "number", F.lead("number").over(inner).alias("next"))
    ends = chunked.groupBy(series, "_chunk").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    starts = ends.select(series, F.lit(-1).cast("bigint").alias("_chunk"), F.lit(0).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("last")).distinct()
    outer = Window.partitionBy(series).orderBy("_chunk")
    between = ends.unionByName(starts).select(series, F.col("last").alias("number"), F.lead("first").over(outer).alias("next"))
    gaps = within.unionByName(between).where(F.col("next") > F.col("number") + 1)
    return (gaps.join(known, series)
            .select(series, (F.col("number") + 1).alias("low"), (F.col("next") - 1).alias("high"), "total_loans"))


def missing_volumes(df, series, volume, loans, min_held: int = 2) -> DataFrame:
    """The numbers of ``missing_ranges``, one row each, generated in stretches of 1,000."""
    ranges = missing_ranges(df, series, volume, loans, min_held)
    parts = ranges.withColumn("_from", F.explode(F.sequence("low", "high", F.lit(CHUNK).cast("bigint"))))
    return parts.select(series, F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK - 1, F.col("high")))).alias("missing"), "total_loans")


def next_volumes(df, offers, series, volume, loans, ahead: int = 6, min_held: int = 3) -> DataFrame:
    """highest+1 .. highest+ahead of well-lent series, up to the first volume
    not on offer.  A series has at most ``ahead`` rows when cut."""
    held = (df.withColumn("number", volume_number(df, volume))
            .where(present(df, series) & F.col("number").isNotNull())
            .groupBy(series, "number").agg(F.sum(loans).alias("_loans")))
    known = (held.groupBy(series)
             .agg(F.count(F.lit(1)).alias("volumes_held"), F.max("number").alias("highest"),
                  F.sum("_loans").alias("total_loans"))
             .where((F.col("volumes_held") >= min_held) & (F.col("total_loans") > 0)))
    steps = known.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    steps = steps.withColumn("number", F.col("highest") + F.col("step"))
    on_offer = (offers.select(series, volume_number(offers, volume).alias("number"))
                .distinct().withColumn("offered", F.lit(True)))
    found = steps.join(on_offer, [series, "number"], "left")
    first_gap = (found.groupBy(series, "highest", "total_loans")
                 .agg(F.coalesce(F.min(F.when(F.col("offered").isNull(), F.col("step"))),
                                 F.lit(ahead + 1)).alias("_gap"))
                 .where(F.col("_gap") > 1))
    return (first_gap.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("_gap") - 1)))
            .select(series, "highest", (F.col("highest") + F.col("step")).alias("next_volume"),
                    "total_loans"))


def gap_diagnosis(df, series, volume, suspect: Column) -> DataFrame:
    """Gaps against suspect records: badly catalogued, to check, truly absent."""
    number = volume_number(df, volume)
    held = (df.where(present(df, series))
            .groupBy(series, number.alias("number"))
            .agg(F.sum(F.when(suspect, 1).otherwise(0)).alias("_suspect")))
    out = (held.groupBy(series)
           .agg((F.max("number") - F.count("number")).alias("gaps"),
                F.sum("_suspect").alias("suspects"))
           .where(F.col("gaps") > 0))
    return out.withColumn("verdict", F.when(F.col("suspects") >= F.col("gaps"), "badly catalogued")
                          .when(F.col("suspects") > 0, "check").otherwise("truly absent"))


def series_stock(df, series, volume, loans, category, creators, audience=None,
                 audiences=None, categories=None) -> DataFrame:
    """Per folded series: volumes held, highest, loans, category, first author."""
    if audiences:
        df = df.where(F.col(audience).isin(*audiences))
    if categories:
        df = df.where(F.col(category).isin(*categories))
    return (df.withColumn("series_key", fold_text(series, "drop")).where(F.col("series_key") != "")
            .groupBy("series_key")
            .agg(F.min(series).alias("series"), F.sum(F.coalesce(F.col(loans), F.lit(0))).alias("loans"),
                 F.min(category).alias("category"), F.min(author_first(creators)).alias("author"),
                 F.max(leading_int(volume)).alias("highest")))


def cap_per_group(df, group, order, k: int) -> DataFrame:
    """At most k rows of each group in the given order."""
    return top_per_key(df, [group], order, k)


def holdings_report(titles: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row of conditional counts, computed in one pass."""
    return titles.agg(F.count(F.lit(1)).alias("total"), *[
        F.sum(F.when(test, 1).otherwise(0)).alias(name) for name, test in conditions.items()])


def basket_recap(df, origin, category, price) -> DataFrame:
    """Rows and amount by origin, by category and in all, in one pass."""
    return (df.groupingSets([[origin], [category], []], origin, category)
            .agg(F.count(F.lit(1)).alias("items"), F.sum(price).alias("amount"),
                 F.grouping_id().alias("_level"))
            .select(F.when(F.col("_level") == 1, "origin").when(F.col("_level") == 2, "category")
                    .otherwise("total").alias("level"),
                    F.coalesce(F.col(origin), F.col(category), F.lit("all")).alias("value"),
                    "items", "amount"))
