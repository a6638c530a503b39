"""Withdrawal candidates and shelfmark audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import vocab as V
from shelfspark.functions.text import text_or_empty
from shelfspark.operators.keyed import attach_by_key


def weeding_candidates(copies: DataFrame, key, kind, category, audience, dewey, published, loans,
                       last_loan_year, year: int) -> DataFrame:
    """Copies (already joined to their title) by withdrawal class.

    The classes are a union: a copy can fall under a rule and also be a dormant
    duplicate.  The copies per title come from one aggregation attached with
    its hot keys split off; the two classes are exploded from the same row, so
    the copies are read once for both."""
    books = copies.where((F.col(kind) == "LIVRE") & (text_or_empty(category) != "Fonds local"))
    per_title = books.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    # only titles with three copies or more can have dormant duplicates
    marked = attach_by_key(books, per_title.where(F.col("copies") >= 3), key, "copies")
    age = F.lit(year) - F.regexp_extract(F.col(published).cast("string"), "^(\\d{4})", 1).try_cast("int")
    rule = R.weeding_class(dewey, category, audience, age, loans, last_loan_year, year)
    idle = F.lit(year) - F.col(last_loan_year)
    # no class takes a copy lent within the shortest idle time of any rule
    shortest = min(3, *(band[3] for band in V.DEWEY_BANDS))
    marked = marked.where(F.col(last_loan_year).isNull() | (idle >= shortest))
    double = F.when(F.col("copies").isNotNull() & (idle >= 3), F.struct(
        F.lit(V.WEEDING_CLASSES["duplicate"]).alias("class"),
        F.concat(F.col("copies").cast("string"), F.lit(" exemplaires, celui-ci sans prêt depuis "),
                 idle.cast("string"), F.lit(" ans")).alias("rule")))
    return (marked.withColumn("_c", F.explode(F.array_compact(F.array(rule, double))))
            .select(*copies.columns, F.col("_c.class").alias("class"), F.col("_c.rule").alias("rule")))


def film_audit(copies: DataFrame, shelfmark, publisher, creators, audience) -> DataFrame:
    """One row per anomaly of each film copy."""
    found = R.film_anomalies(shelfmark, publisher, creators, audience)
    return (copies.withColumn("anomaly", F.explode(found))
            .withColumn("label", R.lookup(F.col("anomaly"), V.FILM_ANOMALIES)))
