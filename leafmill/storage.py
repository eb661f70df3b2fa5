"""Written tables in the folder that driver and executors share.

Everything an application writes for itself lies in one folder named by its application id, so what a lost job left
behind is found, and deleted, in one place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session on one machine that names no shared folder (tests).
LOCAL_FALLBACK = "file:///tmp/checkpoints/leafmill"


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder in ``spark.checkpoint.dir``; on a cluster that setting is needed."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = LOCAL_FALLBACK
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/leafmill-{tag}-{uuid.uuid4().hex}"


#: Spark's own setting that deletes an execution's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts lineage with files that outlive any executor, so a lost executor costs only its running tasks.  What the
    write has shuffled is not read again and is deleted with it.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files offer fewer tasks than that (few, or one row group); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` for the small side of a join: counted, and broadcast if it has ``most`` rows or fewer; else left to Spark.

    For sides that come from stated queries, whose size Spark cannot tell before it has shuffled the other side.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
