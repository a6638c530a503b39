"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan here relies on.  All can be set on a live
# session; sizes (shuffle partitions, file split size) stay with the cluster.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


READ_PARTS = "spark.sql.files.minPartitionNum"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's checkpoint directory.

    A local session that names none (tests) gets a temporary folder, recorded in
    the session; on a cluster executors would each write to their own disk, so
    there the setting is required.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not (context.master or "").startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="shelfspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def arrow_place(path: str):
    """Arrow's file system and path of a place in the shared folder, for tasks that read it themselves."""
    import pyarrow.fs
    return pyarrow.fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, for work that costs far more than its input's bytes
    tell: a file of a few MB is one task, however many rows it holds.  What is made of the rows is
    to be written before it is filtered, in the tasks dealt here: filters would be pushed below the
    repartitioning, and a small stored table would be read by as many tasks as there are cores."""
    return df.repartition(dealt_parts(df.sparkSession))


def dealt_parts(spark: SparkSession) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_widely(spark: SparkSession) -> SparkSession:
    """Stored records and titles are few bytes and much work: their files are read in as many tasks
    as they were dealt to, not packed by bytes into one task a core and a few left over, which
    run alone at the end.  A number given by the job stays."""
    if spark.conf.get(READ_PARTS, None) is None:
        spark.conf.set(READ_PARTS, dealt_parts(spark))
    return spark
