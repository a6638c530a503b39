"""Exports and keyed replacement of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import fold_text, text_or_empty
from shelfspark.session import materialise

# Labels of the inventory export, in column order.
INVENTORY_LABELS = (
    ("identifier", "Identifiant"), ("barcode", "Code-barres"), ("shelfmark", "Cote"),
    ("title", "Titre"), ("series", "Série"), ("volume", "Tome"), ("author", "Auteur"),
    ("illustrator", "Illustrateur"), ("translator", "Traducteur"), ("publisher", "Éditeur"),
    ("published", "Date de publication"), ("kind", "Type de document"), ("category", "Catégorie"),
    ("genre", "Genre"), ("audience", "Public"), ("dewey", "Dewey"), ("keywords", "Mots-clés"),
    ("status", "Statut"), ("support", "Support"), ("entered", "Date d'entrée"), ("loans", "Prêts"),
)


def labelled(df: DataFrame, labels=INVENTORY_LABELS) -> DataFrame:
    """Columns under their labels; a column the frame lacks stays empty."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None).cast("string")).alias(label)
                       for c, label in labels])


def export_inventory(df: DataFrame, path: str) -> None:
    """Labelled columns ordered by title and barcode (a range-partitioned sort,
    so the files follow one another in order)."""
    labelled(df.orderBy("title", "barcode")).write.mode("overwrite").csv(path, header=True, sep=";")


def export_query(df: DataFrame, path: str, *order, cap: int = 100_000, labels=INVENTORY_LABELS) -> DataFrame:
    """Any selection up to the export's row limit, the first rows in the given
    order; friendly labels if the frame has all the usual columns.  Returns one
    row: ``total`` and whether rows were ``cut``."""
    shown = df.orderBy(*order).limit(cap) if order else df.limit(cap)
    if {c for c, _ in labels} <= set(df.columns):
        shown = labelled(shown, labels)
    shown.write.mode("overwrite").csv(path, header=True, sep=";")
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("cut", F.col("total") > cap)


def order_lines(basket: DataFrame) -> DataFrame:
    """The basket in order form: origin, category, series, padded volume."""
    return basket.orderBy("origin", "category", fold_text("series", "drop"),
                          F.lpad(text_or_empty(F.col("volume").cast("string")), 3, "0"), "ean")


def export_order(basket: DataFrame, folder: str) -> None:
    """``EAN;Quantité`` lines and the plain list of codes."""
    lines = order_lines(basket)
    lines.select(F.col("ean").alias("EAN"), F.lit(1).alias("Quantité")).write.mode("overwrite").csv(
        f"{folder}/order_csv", header=True, sep=";")
    lines.select("ean").write.mode("overwrite").text(f"{folder}/order_txt")


def export_by_class(df: DataFrame, column: str, path: str, shelfmark: str, *then) -> None:
    """One folder per class, rows in shelf order within each file."""
    key = F.coalesce(F.when(F.trim(text_or_empty(shelfmark)) != "", F.col(shelfmark)), F.lit("zzz"))
    (df.repartitionByRange(column, key, *then).sortWithinPartitions(column, key, *then)
     .write.mode("overwrite").partitionBy(column).csv(path, header=True, sep=";"))


def slides(df: DataFrame) -> DataFrame:
    """One JSON object per title for the display wall."""
    line = lambda c: F.regexp_replace(text_or_empty(F.col(c).cast("string")), "\\r\\n|\\r|\\n", " ")
    return df.select(F.to_json(F.struct(
        line("title").alias("t"), line("author").alias("a"), line("year").alias("y"),
        line("publisher").alias("ed"), line("shelfmark").alias("cote"), line("audience").alias("pub"),
        line("support").alias("sup"), line("abstract").alias("d"), line("identifier").alias("isbn"),
        line("cover").alias("img"))).alias("value"))


def export_slides(df: DataFrame, path: str) -> None:
    slides(df).write.mode("overwrite").text(path)


def upserted(target: DataFrame, source: DataFrame, keys, set_cols) -> DataFrame:
    """The target with the source's rows inserted, or their ``set_cols`` replaced
    where the key exists.  The source has one row per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    new = source.select(*keys, F.struct(*[c for c in source.columns if c not in keys]).alias("_n"))
    old = target.withColumn("_old", F.lit(True))
    both = old.join(new, keys, "full")
    given = set(source.columns)
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in given:
            out.append(F.col(c))
        elif c in set_cols:
            out.append(F.when(F.col("_n").isNotNull(), F.col("_n")[c]).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col("_n")[c]).alias(c))
    return both.select(*out)


def upsert(spark: SparkSession, path: str, source: DataFrame, keys, set_cols, partition: str | None = None) -> None:
    """Keyed replacement in a stored parquet table.

    The result is first written to the shared folder, then put in place, so
    the table is never overwritten while read.  With a ``partition`` column
    (one that the key determines) only the partitions the source touches are
    read, merged and replaced."""
    try:
        target = spark.read.parquet(path)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        writer = source.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        return
    if partition:
        touched = source.select(partition).distinct()
        keys = [*([keys] if isinstance(keys, str) else keys), partition]
        merged = upserted(target.join(touched, partition, "left_semi"), source, list(dict.fromkeys(keys)), set_cols)
    else:
        merged = upserted(target, source, keys, set_cols)
    ready = materialise(merged, "upsert")
    writer = ready.write.mode("overwrite")
    if partition:
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    else:
        writer.parquet(path)
