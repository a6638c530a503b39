"""Per-key building blocks that stay distributed when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import materialise

HOT_KEYS = 256          # most frequent keys joined by broadcast in attach_by_key
SPREAD = 64             # slices a hot group is cut into before its final pass

asc_nf = "asc_nulls_first"


def _sorters(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def row_salt(columns, slices: int = SPREAD) -> Column:
    """Stable slice number of a row, from its own values (same on a retry)."""
    return F.pmod(F.xxhash64(*columns), F.lit(slices)).cast("int")


def top_per_key(df: DataFrame, keys, order, n, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in the given total order.

    ``n`` is a number, or a column constant within a key.  With a number Spark
    cuts each map task's groups to ``n`` rows before the shuffle (window group
    limit).  With a column the same is done explicitly over slices of the key.
    """
    sorters = _sorters(order)
    name = rank or "_rank"
    if not isinstance(n, int):
        sliced = Window.partitionBy(*keys, "_slice").orderBy(*sorters)
        df = (df.withColumn("_slice", row_salt(df.columns))
              .withColumn("_rank_in_slice", F.row_number().over(sliced))
              .where(F.col("_rank_in_slice") <= n).drop("_slice", "_rank_in_slice"))
    whole = Window.partitionBy(*keys).orderBy(*sorters)
    kept = df.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in the order (first write wins)."""
    return top_per_key(df, keys, order, 1)


def last_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the last in the order (last write wins)."""
    return top_per_key(df, keys, [F.col(o).desc() if isinstance(o, str) else o for o in order], 1)


def first_with_ignored(df: DataFrame, keys, order) -> DataFrame:
    """First row per key plus the number of later rows ignored.

    Orders given as column names need one aggregation; other orders a window and
    a join with the counts."""
    if all(isinstance(o, str) for o in order):
        rest = [c for c in df.columns if c not in {*keys, *order}]
        row = F.min(F.struct(*order, *rest)).alias("_row")
        out = df.groupBy(*keys).agg(row, (F.count(F.lit(1)) - 1).alias("ignored"))
        return out.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns], "ignored")
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("ignored"))
    return first_per_key(df, keys, order).join(counts, keys)


def attach_by_key(df: DataFrame, per_key: DataFrame, keys, weight: str) -> DataFrame:
    """Left join to a frame with one row per key whose ``weight`` column counts
    the rows of ``df`` having that key.

    The HOT_KEYS heaviest keys (a fixed number of rows) are joined by
    broadcast, so their rows never meet in one task; only the rest is shuffled
    on the key, rows already served being spread over all partitions.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    values = [c for c in per_key.columns if c not in keys]
    hot = per_key.orderBy(F.col(weight).desc(), *keys).limit(HOT_KEYS)
    hot = hot.select(*keys, F.struct(*values).alias("_hot"))
    served = df.join(F.broadcast(hot), keys, "left")
    served = served.withColumn(
        "_slot", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + row_salt(df.columns)))
    cold = per_key.select(*keys, F.struct(*values).alias("_cold"), F.lit(0).alias("_slot"))
    joined = served.join(cold, [*keys, "_slot"], "left")
    value = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*df.columns, *[value[v].alias(v) for v in values])


def modal_values(df: DataFrame, group, value: str, weight: Column | None = None) -> DataFrame:
    """Most frequent value of each group (ties: smallest value) with the number
    of rows and of distinct values.  Two aggregations, no join, no group is
    gathered."""
    group = [group] if isinstance(group, str) else list(group)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    forms = df.groupBy(*group, value).agg(n.alias("_n"))
    # the smallest value among those with the highest count
    first = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).isNull().alias("none"), F.col(value).alias("value")))
    return forms.groupBy(*group).agg(first["value"].alias("modal"), F.sum("_n").alias("group_rows"),
                                     F.count(F.lit(1)).alias("group_values"))


def exact_rank(df: DataFrame, keys, order, name: str = "rank") -> DataFrame:
    """Row number within each key without one task per key.

    Rows are range-partitioned on (key, order) and written once to the shared
    folder, so a lost executor cannot change the cut; the number is the row's
    place in its file part plus the rows of the key in earlier parts.  The
    table of parts has one row per (part, key) and is joined on both.
    """
    keys = list(keys)
    sorters = [F.col(k) for k in keys] + _sorters(order)
    parts = materialise(df.repartitionByRange(*sorters).withColumn("_part", F.spark_partition_id()),
                        "rank")
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    local = Window.partitionBy(*keys, "_part").orderBy(*_sorters(order))
    return (parts.withColumn("_place", F.row_number().over(local))
            .join(sizes, [*keys, "_part"])
            .withColumn(name, F.col("_before") + F.col("_place"))
            .drop("_part", "_place", "_before", "_size"))
