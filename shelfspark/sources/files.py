"""Delimited exports, code lists, decision sheets, and which file is which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import file_date, filled, fr_datetime, safe_int, valid_ean
from shelfspark.operators.footfall import counter_rows

# Column names of the loan exports.
COPY_CODE = "Code-barres de l'exemplaire"
TITLE_CODE = "EAN / ISBN"
TITLE_COLUMNS = {
    "total": "Nombre de prêts total",
    "current_year": "Nombre de prêts année en cours",
    "n1": "Nombre de prêts N-1",
    "n2": "Nombre de prêts N-2",
    "n3": "Nombre de prêts N-3",
    "functional": "Nombre de prêts fonctionnels",
}
LAST_LOAN = "Date de dernier prêt"
PLACE = "_place"        # where a row stands in its files, see file_order
COPY_COLUMNS = {"loans": "Nombre de prêts total (ex)", "last_year": "Année du dernier prêt"}


def file_order() -> Column:
    """Text that sorts rows by file, block of the file, and place in the block.

    Splits are packed into tasks by size, so the running number of a row alone
    follows neither files nor blocks; within a block it does."""
    return F.concat_ws("#", "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 18, "0"),
                       F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))


def _read_with_header(spark: SparkSession, path: str, sep: str, is_header, first: int = 3):
    """Rows of a delimited file under the header found in its first lines.

    Only those few lines come to the driver; the rows are read by Spark with
    every column as text, and the lines up to the header are dropped by value."""
    top = [r.value for r in spark.read.text(path).limit(first).collect()]
    for line in top:
        names = [n.strip().strip('"').lstrip("\ufeff") for n in line.split(sep)]
        if is_header(names):
            break
    else:
        raise ValueError(f"no known header in the first {first} lines of {path}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = spark.read.csv(path, schema=schema, sep=sep, mode="PERMISSIVE").select("*", file_order().alias("_place"))
    heading = F.lit(True)
    for i, n in enumerate(names):
        heading = heading & (F.coalesce(F.trim(F.ltrim(F.replace(f"c{i}", F.lit("\ufeff"), F.lit("")))), F.lit("")) == n)
    rows = rows.where(~heading & ~F.coalesce(F.col("c0").startswith("sep="), F.lit(False)))
    return rows.toDF(*names, PLACE), names


def read_loans(spark: SparkSession, path: str, sep: str = ";", placed: bool = False) -> tuple[str, DataFrame]:
    """('copy' | 'title', rows).  The layout is recognised by its code column.  Rows per title have
    their place (``pos``), rows per copy with ``placed``."""
    rows, names = _read_with_header(
        spark, path, sep, lambda n: any("barres" in x.lower() or "EAN" in x or "ISBN" in x for x in n))
    if COPY_CODE in names:
        found = loans_per_copy(rows)
        return "copy", found if placed else found.drop("pos")
    if TITLE_CODE in names:
        return "title", loans_per_title(rows)
    raise ValueError(f"unknown loan layout: {names}")


def loans_per_copy(rows: DataFrame) -> DataFrame:
    q = "`{}`".format
    loans = (safe_int(F.col(q(COPY_COLUMNS["loans"]))) if COPY_COLUMNS["loans"] in rows.columns
             else F.lit(None).cast("bigint"))
    year = (safe_int(F.col(q(COPY_COLUMNS["last_year"]))) if COPY_COLUMNS["last_year"] in rows.columns
            else F.lit(None).cast("bigint"))
    code = F.trim(F.col(q(COPY_CODE)))
    return rows.where(filled(code)).select(code.alias("barcode"), loans.alias("loans"),
                                           year.cast("string").alias("last_loan_year"), F.col(PLACE).alias("pos"))


def loans_per_title(rows: DataFrame) -> DataFrame:
    q = "`{}`".format
    figures = [(safe_int(F.col(q(c))) if c in rows.columns else F.lit(None).cast("bigint")).alias(n)
               for n, c in TITLE_COLUMNS.items()]
    last = fr_datetime(F.col(q(LAST_LOAN))) if LAST_LOAN in rows.columns else F.lit(None).cast("string")
    return rows.select(F.col(q(TITLE_CODE)).alias("raw_code"), valid_ean(F.col(q(TITLE_CODE))).alias("ean"),
                       F.col(PLACE).alias("pos"), *figures, last.alias("last_loan"))


def read_footfall(spark: SparkSession, path: str) -> DataFrame:
    """Counter rows (ts, entries) of either header dialect."""
    rows, names = _read_with_header(spark, path, ";", lambda n: "DATE" in n or "Date" in n)
    date = "DATE" if "DATE" in names else "Date"
    entries = "IN" if "IN" in names else "Entrées"
    hour = "HOUR" if "HOUR" in names else "Heure"
    return counter_rows(rows, date, hour, entries)


def code_list(lines: DataFrame, line="value", digits_only: bool = False) -> DataFrame:
    """Codes of a list: comments (whole line or trailing) and blanks removed."""
    code = F.regexp_replace(F.regexp_extract(F.col(line), "^([^#]*)", 1), "\\s+", "")
    out = lines.withColumn("code", code).where(F.col("code") != "").drop(line)
    return out.where(F.col("code").rlike("^\\d+$")) if digits_only else out


def read_code_list(spark: SparkSession, path, digits_only: bool = False) -> DataFrame:
    return code_list(spark.read.text(path), digits_only=digits_only)


def decision_pairs(sheet: DataFrame, old, new) -> DataFrame:
    """Approved changes: both sides set and different."""
    o, n = F.trim(F.col(old)), F.trim(F.col(new))
    return sheet.where(filled(old) & filled(new) & (o != n)).select(o.alias("old"), n.alias("new")).distinct()


def read_decision_sheet(spark: SparkSession, path, old, new, sep=";") -> DataFrame:
    return decision_pairs(spark.read.csv(path, header=True, sep=sep), old, new)


# File endings and the feed they carry.
FEED_KINDS = {"mrc": "catalogue", "xlsx": "loans", "xls": "loans", "csv": "footfall"}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length of a folder; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")


def route_inputs(files: DataFrame) -> DataFrame:
    """Newest file of each feed kind with the date in its name."""
    from shelfspark.functions.rules import lookup
    ending = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    kinds = files.withColumn("feed", lookup(ending, FEED_KINDS)).where(F.col("feed").isNotNull())
    newest = F.max(F.struct("modificationTime", "path"))
    return (kinds.groupBy("feed").agg(newest.alias("_n"), F.count(F.lit(1)).alias("files"))
            .select("feed", F.col("_n.path").alias("path"), "files", file_date("_n.path").alias("file_date")))


def copy_tables(spark: SparkSession, source: str, target: str, names) -> list[str]:
    """Copy tables one by one; absent and empty ones are skipped."""
    from pyspark.errors import AnalysisException
    done = []
    for name in names:
        try:
            df = spark.read.parquet(f"{source}/{name}.parquet")
        except AnalysisException:
            continue
        if not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
            done.append(name)
    return done
