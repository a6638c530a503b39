"""Quality figures, reports and rewrites of whole columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import col, filled, fold_text, has_ean, series_key
from shelfspark.operators.keyed import attach_by_key, modal_values


def counts(df: DataFrame, columns, name: str = "n") -> DataFrame:
    """Frequency of each combination of values."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def fill_rate(df: DataFrame, columns=None, rare: float = 5.0) -> DataFrame:
    """Filled values per column in a single pass: count, percentage, flag."""
    columns = columns or df.columns
    sums = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.sum(F.when(filled(F.col(c).cast("string")), 1).otherwise(0)).alias(c) for c in columns])
    long = sums.unpivot(["_rows"], columns, "column", "filled")
    share = F.round(100.0 * F.col("filled") / F.col("_rows"), 1)
    return long.select("column", "filled", share.alias("percent"),
                       F.when(F.col("filled") == 0, "empty").when(share < rare, "rare")
                       .otherwise("").alias("flag"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and an empty flag for each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
             for name, df in tables.items()]
    return (reduce(DataFrame.unionByName, parts)
            .withColumn("empty", F.when(F.col("rows") == 0, 1).otherwise(0)))


def value_inventory(df: DataFrame, columns) -> DataFrame:
    """Distinct values and counts of several columns at once."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([], columns, "column", "value")
    return long.where(filled("value")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def scorecard(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Labelled conditional counts, one row per label, from one pass."""
    sums = df.agg(*[F.sum(F.when(test, 1).otherwise(0)).alias(label)
                    for label, test in checks.items()])
    return sums.unpivot([], list(checks), "label", "n")


def filtered_columns(queries: DataFrame, sql: str, order=None, last: int | None = None,
                     k: int | None = 15) -> DataFrame:
    """Names following WHERE, AND and OR in logged statements, by frequency.

    ``last`` keeps the newest statements of the log (the reported window)."""
    if last:
        queries = queries.orderBy(*order).limit(last)
    names = F.regexp_extract_all(F.col(sql), F.lit(r"(?i)\b(?:WHERE|AND|OR)\s+([A-Za-z_][A-Za-z_0-9.]*)"), 1)
    out = (queries.select(F.explode(names).alias("name"))
           .groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    return out.orderBy(F.col("n").desc(), "name").limit(k) if k else out


def usage_report(log: DataFrame, when, error: Column, export: Column, edit: Column,
                 searches: Column) -> DataFrame:
    """Per day: requests, shares of errors, exports and edits, searches."""
    def share(test):
        return F.round(100.0 * F.sum(F.when(test, 1).otherwise(0)) / F.count(F.lit(1)), 1)
    return (log.groupBy(F.date_format(when, "yyyy-MM-dd").alias("day"))
            .agg(F.count(F.lit(1)).alias("requests"), share(error).alias("error_pct"),
                 share(export).alias("export_pct"), share(edit).alias("edit_pct"),
                 F.sum(searches).alias("searches")))


def last_errors(log: DataFrame, when, key, error: Column, k: int = 10) -> DataFrame:
    return log.where(error).orderBy(F.col(when).desc(), F.col(key).desc()).limit(k)


def duplicates(df: DataFrame, title, author, key) -> DataFrame:
    """Same trimmed lower-case title and author: how many, and the first key.
    The keys themselves are listed in rows by ``duplicate_members``."""
    folded = [F.lower(F.trim(F.col(title))).alias("title"), F.col(author).alias("author")]
    return (df.groupBy(*folded).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))
            .where(F.col("n") > 1))


def duplicate_members(df: DataFrame, title, author, key) -> DataFrame:
    """(first key, key) of every record that has a double."""
    groups = duplicates(df, title, author, key)
    keyed = df.select(F.col(key), F.lower(F.trim(F.col(title))).alias("title"),
                      F.col(author).alias("author"))
    return (attach_by_key(keyed, groups, ["title", "author"], "n")
            .where(F.col("first_key").isNotNull()).select("first_key", F.col(key).alias("key")))


def spelling_variants(df: DataFrame, series) -> DataFrame:
    """Folded series written in more than one way."""
    forms = df.where(filled(series)).select(F.col(series).alias("_form")).distinct()
    return (forms.groupBy(fold_text("_form").alias("series_key"))
            .agg(F.count(F.lit(1)).alias("spellings"), F.min("_form").alias("first_form"),
                 F.max("_form").alias("last_form"))
            .where(F.col("spellings") > 1))


def majority_form(existing: DataFrame, incoming: DataFrame, column: str) -> DataFrame:
    """Key (lower case, outer blanks and dots gone) -> most frequent spelling
    over both tables, weighted by rows; ties go to the smallest spelling."""
    both = existing.select(column).unionByName(incoming.select(column)).where(F.col(column).isNotNull())
    return (modal_values(both.withColumn("form_key", series_key(column)), "form_key", column)
            .withColumnRenamed("modal", "form"))


def apply_majority(df: DataFrame, forms: DataFrame, column: str) -> DataFrame:
    """Replace each spelling by its majority form."""
    keyed = df.withColumn("_form_key", series_key(column))
    known = forms.select(F.col("form_key").alias("_form_key"), F.col("form").alias("_form"),
                         F.col("group_rows").alias("_rows"))
    return (attach_by_key(keyed, known, "_form_key", "_rows")
            .withColumn(column, F.coalesce("_form", column)).drop("_form_key", "_form", "_rows"))


def harmonise_by_group(df: DataFrame, group: str, column: str) -> DataFrame:
    """Within each group replace the column by its modal value; ``changed``
    tells which rows differ."""
    usable = df.where(F.col(group).isNotNull() & filled(F.col(column).cast("string")))
    modes = modal_values(usable, group, column)
    joined = attach_by_key(df, modes.select(group, "modal", "group_rows"), group, "group_rows")
    changed = filled(F.col(column).cast("string")) & F.col("modal").isNotNull() & (
        F.col(column) != F.col("modal"))
    return (joined.withColumn("changed", changed)
            .withColumn(column, F.when(F.col("changed"), F.col("modal")).otherwise(F.col(column)))
            .drop("modal", "group_rows"))


def changes_preview(df: DataFrame, old, new) -> DataFrame:
    """Value, target and rows affected, before anything is written."""
    return (df.select(col(old).alias("old"), col(new).alias("new"))
            .where(~F.col("old").eqNullSafe(F.col("new")))
            .groupBy("old", "new").agg(F.count(F.lit(1)).alias("n")))


def mapping_sheet(df: DataFrame, column, rule) -> DataFrame:
    """Proposal table: current value, rows, proposal, changed?, reason.  The rule
    runs once per distinct value, not once per row."""
    return (counts(df.where(filled(column)), [column]).withColumn("_p", rule(F.col(column)))
            .select(F.col(column).alias("current"), "n", F.col("_p.value").alias("proposed"),
                    F.when(F.col("_p.value") == F.col(column), "").otherwise("OUI").alias("changed"),
                    F.col("_p.reason").alias("reason")))


def deduced_fields(df: DataFrame, marker) -> DataFrame:
    """Records per field named in the ``a,b`` marker."""
    names = F.transform(F.split(F.col(marker), ","), lambda s: F.trim(s))
    return (df.where(filled(marker)).select(F.explode(names).alias("field")).where(filled("field"))
            .groupBy("field").agg(F.count(F.lit(1)).alias("n")))


def import_report(rows: DataFrame, raw_code, code, position, known: DataFrame, known_key) -> DataFrame:
    """Rows per outcome: no identifier, invalid, duplicate in the file, out of
    scope, updated.  Duplicates are counted per code, not ranked."""
    none, bad = F.col(raw_code).isNull(), F.col(raw_code).isNotNull() & F.col(code).isNull()
    rejected = (rows.where(none | bad)
                .select(F.when(none, "no_identifier").otherwise("invalid_identifier").alias("reason"),
                        F.lit(1).cast("bigint").alias("rows")))
    per_code = rows.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("_n"))
    held = known.select(F.col(known_key).alias(code)).distinct().withColumn("_held", F.lit(True))
    judged = per_code.join(held, code, "left")
    # both outcomes of a code in one pass over the codes
    first = F.struct(F.when(F.col("_held"), "updated").otherwise("out_of_scope").alias("reason"), F.lit(1).cast("bigint").alias("rows"))
    repeats = F.struct(F.lit("duplicate_in_file").alias("reason"), (F.col("_n") - 1).alias("rows"))
    outcomes = judged.select(F.inline(F.array(first, repeats))).where(F.col("rows") > 0)
    return rejected.unionByName(outcomes).groupBy("reason").agg(F.sum("rows").alias("rows"))


def suggestions_by_source(df: DataFrame, source, pending: Column, automatic: Column) -> DataFrame:
    """Per source: pending suggestions made by a feed (to purge) and kept ones."""
    purge = pending & automatic
    return (df.groupBy(source).agg(F.sum(F.when(purge, 1).otherwise(0)).alias("to_purge"),
                                   F.sum(F.when(purge, 0).otherwise(1)).alias("kept")))


def multi_award(df: DataFrame, title, prize) -> DataFrame:
    """Folded titles entered at least twice in prize lists."""
    named = df.withColumn("title_key", fold_text(title)).where(F.col("title_key") != "")
    return (named.groupBy("title_key", prize).agg(F.count(F.lit(1)).alias("_n"))
            .groupBy("title_key")
            .agg(F.sum("_n").alias("entries"), F.count(F.lit(1)).alias("prizes"),
                 F.min(prize).alias("first_prize"), F.max(prize).alias("last_prize"))
            .where(F.col("entries") > 1))


def source_health(expected: DataFrame, responses: DataFrame, source, title, series, volume,
                  critical=()) -> DataFrame:
    """Per expected source: answered, series and volume present; state silent,
    degraded (critical but no series) or ok."""
    seen = responses.where(filled(title)).groupBy(source).agg(
        F.count(F.lit(1)).alias("answers"), F.max(filled(series).cast("int")).alias("has_series"),
        F.max(filled(volume).cast("int")).alias("has_volume"))
    vital = F.col(source).isin(*critical) if critical else F.lit(False)
    return (expected.select(source).distinct().join(seen, source, "left")
            .select(source, F.coalesce("answers", F.lit(0)).alias("answers"),
                    F.coalesce("has_series", F.lit(0)).alias("has_series"),
                    F.coalesce("has_volume", F.lit(0)).alias("has_volume"))
            .withColumn("state", F.when((F.col("answers") == 0) & vital, "critical silent")
                        .when(F.col("answers") == 0, "silent")
                        .when(vital & (F.col("has_series") == 0), "degraded").otherwise("ok")))


def list_vintage(lists: DataFrame, name, current_year: int) -> DataFrame:
    """Newest year named in the lists and whether it is out of date."""
    year = F.regexp_extract(F.col(name), r"(20\d{2})", 1).try_cast("int")
    return (lists.agg(F.count(F.lit(1)).alias("entries"), F.max(year).alias("newest"))
            .withColumn("stale", F.coalesce(F.col("newest") < current_year, F.lit(True))))


def without_copy(titles: DataFrame, copies: DataFrame, key) -> DataFrame:
    return titles.join(copies.select(key), key, "left_anti")


def copies_without(copies: DataFrame, columns) -> DataFrame:
    """Copies lacking a value, one row per copy and missing column."""
    missing = F.array_compact(F.array(*[F.when(~filled(F.col(c).cast("string")), F.lit(c))
                                        for c in columns]))
    return copies.withColumn("missing", F.explode(missing))


def corrections_worklist(titles: DataFrame, marker, values: dict[str, str], series, volume) -> DataFrame:
    """One row per deduced field with the value to enter; a doubtful series goes
    to its own list with the reason."""
    from shelfspark.functions.rules import series_or_collection
    verdict = series_or_collection(series, volume)
    by_name = F.create_map(*[x for n, c in values.items()
                             for x in (F.lit(n), F.col(c).cast("string"))])
    fields = F.filter(F.transform(F.split(F.col(marker), ","), lambda s: F.trim(s)), lambda s: s != "")
    rows = titles.where(filled(marker)).withColumn("_v", verdict).withColumn("field", F.explode(fields))
    doubtful = (F.col("field") == "serie") & ~F.col("_v.ok")
    return (rows.withColumn("value", F.coalesce(F.try_element_at(by_name, F.col("field")), F.lit("")))
            .withColumn("list", F.when(doubtful, "doubtful").otherwise("certain"))
            .withColumn("reason", F.when(doubtful, F.col("_v.reason"))).drop("_v"))


def missing_ean(titles: DataFrame, key, kind, published, since: int = 2000) -> DataFrame:
    """Books since a year whose identifier is a substitute."""
    year = F.regexp_extract(F.col(published).cast("string"), "^(\\d{4})", 1).try_cast("int")
    return titles.where(~has_ean(key) & (F.col(kind) == "LIVRE") & (year >= since))
