"""Training-text pipeline: toxic documents go, of near-duplicates one stays, repeated passages and
benchmark leaks go, and what is left is encoded into pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  ``run`` writes
each stage's result as Parquet to the shared folder and hands the reread table to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import decontamination, minhash, pieces, suffix_dedup, toxicity
from shelfspark.llm.common import Stored, in_part, prepared, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; labels of one fold in four are not learned from."""
    prepared(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~in_part(2, 4)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component."""
    prepared(spark)
    return minhash.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 200-byte passages that also start elsewhere."""
    prepared(spark)
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    prepared(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids, their number, and whether decoding restores the text."""
    prepared(spark)
    vocabulary = pieces.shared_vocabulary(docs)
    both = pieces.decode(pieces.encode(docs, shared=vocabulary), shared=vocabulary)
    return both.select(*docs.columns, "tokens", F.coalesce(F.size("tokens"), F.lit(0)).alias("n_tokens"),
                       F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("piece_encoding", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stored = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        docs, before = stored.read(), stored
    return docs
