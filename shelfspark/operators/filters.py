"""Selections, orders and set operations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.keyed import exact_rank
from shelfspark.functions.text import blank, col, filled, fold_text, has_ean, text_or_empty


def inventory_view(titles: DataFrame, copies: DataFrame, key, labels: dict[str, str]) -> DataFrame:
    """Titles with or without copies, one row per copy, columns renamed."""
    joined = titles.join(copies, key, "left")
    return joined.select(*[F.col(c).alias(label) for c, label in labels.items()])


def pending_enrichment(df, key, enriched, kind, series) -> DataFrame:
    """Has an EAN and was never enriched, or is a book without a series."""
    return df.where(has_ean(key) & (F.col(enriched).isNull()
                                    | ((F.col(kind) == "LIVRE") & blank(series))))


def missing_series_volume(df, key, kind, series, volume) -> DataFrame:
    return df.where(has_ean(key) & (F.col(kind) == "LIVRE")
                    & F.col(series).isNull() & F.col(volume).isNull())


def to_qualify(df, kind, category, genre) -> DataFrame:
    """Books without a category, then those with one but without a genre."""
    books = df.where(F.col(kind) == "LIVRE")
    return (books.where(blank(category)).withColumn("reason", F.lit("no category"))
            .unionByName(books.where(filled(category) & blank(genre))
                         .withColumn("reason", F.lit("no genre"))))


def recent_items(df, entered, today: str, months: int = 4) -> DataFrame:
    """Entered in the last months; the day of the limit is at most the 28th."""
    limit = F.add_months(F.trunc(F.lit(today).cast("date"), "month"), -months)
    limit = F.date_add(limit, F.least(F.dayofmonth(F.lit(today).cast("date")), F.lit(28)) - 1)
    return df.where(F.col(entered).cast("date") >= limit)


def new_since(df, created, today: str, days: int = 8) -> DataFrame:
    return df.where(F.col(created).cast("date") >= F.date_sub(F.lit(today).cast("date"), days))


def segments(category, shelfmark, audience) -> dict[str, Column]:
    """Named parts of the collection."""
    category, audience = F.col(category), F.col(audience)
    comic, youth_mark = category == "BD", F.upper(text_or_empty(shelfmark)).startswith("BDJ")
    return {
        "bd_jeunesse": comic & youth_mark,
        "bd_adulte": comic & ~youth_mark,
        "comics": comic & F.upper(text_or_empty(shelfmark)).contains("COM"),
        "roman_graphique": comic & F.upper(text_or_empty(shelfmark)).contains("RG"),
        "manga_jeunesse": (category == "Manga") & (audience == "Jeunesse"),
        "manga_adulte": (category == "Manga") & (audience == "Adulte"),
    }


def keyword_filter(df, columns, word: str, facets: dict[str, list] | None = None) -> DataFrame:
    """Lower-case substring over several columns, and multi-value facets."""
    for name, values in (facets or {}).items():
        if values:
            df = df.where(F.col(name).isin(*values))
    if word:
        df = df.where(F.lower(F.concat_ws(" ", *[F.col(c) for c in columns])).contains(word.lower()))
    return df


def title_lookup(df, term: str, title, series, key) -> DataFrame:
    """Accent- and case-insensitive search with the state of each answer."""
    wanted = fold_text(F.lit(term))
    found = df.where(F.concat_ws(" ", fold_text(title), fold_text(series)).contains(wanted))
    return found.withColumn("state", F.when(has_ean(key), "found").otherwise("found without EAN"))


def title_answer(df, term: str, title, series, key) -> DataFrame:
    """One row: the term, how it is held (found, found without EAN, absent), and the rows found."""
    best = F.max(F.when(F.col("state") == "found", 2).otherwise(1))
    return title_lookup(df, term, title, series, key).agg(best.alias("_b"), F.count(F.lit(1)).alias("rows")).select(
        F.lit(term).alias("term"), F.when(F.col("_b") == 2, "found").when(F.col("_b") == 1, "found without EAN").otherwise("absent").alias("state"), "rows")


FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "replace", "attach", "pragma")


def guarded_query(spark: SparkSession, sql: str, cap: int = 500) -> tuple[DataFrame, DataFrame]:
    """A read-only statement, shown up to ``cap`` rows, with its full count.

    Returns (rows shown, one row: total and whether rows were cut)."""
    text = sql.strip().rstrip(";")
    if not re.match(r"(?i)^(select|with)\b", text):
        raise ValueError("only SELECT statements are accepted")
    if re.search(r"(?i)\b(" + "|".join(FORBIDDEN) + r")\b", text):
        raise ValueError("the statement contains a forbidden word")
    whole = spark.sql(text)
    totals = whole.agg(F.count(F.lit(1)).alias("total")).withColumn("cut", F.col("total") > cap)
    return whole.limit(cap), totals


# --- orders ---------------------------------------------------------------------------

def boolean_first(first: Column, *then) -> list:
    """Rows for which ``first`` holds, then the others."""
    return [first.cast("int").desc(), *then]


def by_shelf(shelfmark, *then) -> list:
    """By shelfmark, blanks last, then the given columns."""
    return [F.coalesce(F.when(filled(shelfmark), F.col(shelfmark)), F.lit("zzz")), *then]


def by_confidence(confidence, *then) -> list:
    c = col(confidence)
    return [F.when(c == "élevée", 0).when(c == "moyenne", 1).when(c == "faible", 2).otherwise(3), *then]


def sort_boolean_first(df, first: Column, *then) -> DataFrame:
    return df.orderBy(*boolean_first(first, *then))


def shelf_order(df, shelfmark, *then) -> DataFrame:
    return df.orderBy(*by_shelf(shelfmark, *then))


def confidence_order(df, confidence, *then) -> DataFrame:
    return df.orderBy(*by_confidence(confidence, *then))


def placed(df, order) -> DataFrame:
    """Every row with its ``place`` in the order, numbered over range partitions."""
    return exact_rank(df, [], order, "place")


def page(df, n: int, offset: int, *unique_key) -> DataFrame:
    """Stable page: the order must end in a unique key."""
    return df.orderBy(*unique_key).offset(offset).limit(n)


# --- sets ---------------------------------------------------------------------------------

def union_exclusions(column: str, *frames: DataFrame) -> DataFrame:
    """Distinct codes of all lists (holdings, open orders, uncatalogued scans)."""
    out = frames[0].select(column)
    for other in frames[1:]:
        out = out.unionByName(other.select(column))
    return out.where(filled(F.col(column).cast("string"))).distinct()


def except_keys(df, keys, *others: DataFrame) -> DataFrame:
    """Rows whose key is in none of the other frames."""
    for other in others:
        df = df.join(other.select(*keys), keys, "left_anti")
    return df


def purge(df, doomed: Column) -> DataFrame:
    """All rows but the doomed ones; a NULL test keeps the row."""
    return df.where(~F.coalesce(doomed, F.lit(False)))
