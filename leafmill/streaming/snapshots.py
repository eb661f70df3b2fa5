"""A text index in versions: a reader sees the index before a batch or after it, whatever a batch dies of.

``data``: rows by batch and book; ``versions/<n>``: which batch holds each book's rows in version n; ``CURRENT``: the version
that counts, replaced by one rename.  A batch writes rows of the books it touches, then a version, then the pointer; what a
batch that died has left is in no version and :func:`vacuum` deletes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I

COLUMNS = ("norm", "norms", "raws")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, path: str) -> str | None:
    """The version that counts; None before the first batch."""
    fs, at = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Replace the pointer: written beside it, then renamed over it in one step."""
    fs, beside = _fs(spark, f"{path}/CURRENT-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context.rename(beside, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT"), over)


def read(spark: SparkSession, path: str, page: str = "page_id", book: str = "book", version: str | None = None) -> DataFrame | None:
    """The index of a version (the current one): ``page, norm, norms, raws, book``; None before the first batch, or where no book is left.

    Only folders that the version names are read: the join on the partition columns prunes the rest.
    """
    version = version or current(spark, path)
    if version is None:
        return None
    held = spark.read.parquet(f"{path}/versions/{version}").select("batch", F.concat(F.lit("b"), F.col(book)).alias("__book"))
    if held.isEmpty():
        return None
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(held, (rows["batch"] == held["batch"]) & rows["__key"].eqNullSafe(held["__book"]), "left_semi").drop("batch", "__key")


def apply(pages: DataFrame, path: str, page: str = "page_id", book: str = "book", text: str = "text", on_step: Callable[[str], None] = lambda step: None) -> str:
    """Apply changed pages (``version`` tells the last of a page's) as one batch; returns the new version.

    An empty or null text drops its page.  ``on_step`` is told of each step before it is taken (tests stop a batch there).
    Applying a batch again gives the same index.  Books that a batch does not touch are not read or written.
    """
    spark, before = pages.sparkSession, current(pages.sparkSession, path)
    last = pages.groupBy(page, book).agg(F.max_by(text, "version").alias(text))
    fresh = I.index_pages(last, page, book, text).select(page, *COLUMNS, book)
    held = read(spark, path, page, book, before) if before is not None else None
    if held is not None:
        old = held.join(last.select(book).distinct(), book, "left_semi")
        fresh = I.refresh(old, last, fresh.select(*old.columns), page)
    batch = uuid.uuid4().hex
    on_step("rows")
    fresh.withColumn("batch", F.lit(batch)).withColumn("__key", F.concat(F.lit("b"), F.col(book))).write.mode("append").partitionBy("batch", "__key").parquet(f"{path}/data")
    on_step("version")
    try:
        own = spark.read.parquet(f"{path}/data/batch={batch}").select(book).distinct().withColumn("batch", F.lit(batch))
        own = own.select("batch", book)
    except Exception as e:  # a batch that only drops pages has written no file
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        own = last.select(F.lit(batch).alias("batch"), book).limit(0)
    if before is not None:
        own = spark.read.parquet(f"{path}/versions/{before}").join(last.select(book).distinct(), book, "left_anti").select("batch", book).unionByName(own)
    own.coalesce(1).write.parquet(f"{path}/versions/{batch}")
    on_step("pointer")
    _point(spark, path, batch)
    return batch


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete versions and rows that the current version does not name, while no reader is on them; returns how many."""
    now, n = current(spark, path), 0
    if now is None:
        return 0
    kept = {r[0] for r in spark.read.parquet(f"{path}/versions/{now}").select("batch").distinct().collect()}
    for folder, keep in (("versions", {now}), ("data", {f"batch={b}" for b in kept})):
        fs, at = _fs(spark, f"{path}/{folder}")
        for status in fs.listStatus(at) if fs.exists(at) else []:
            if status.isDirectory() and status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)
                n += 1
    return n


def maintain(pages: DataFrame, path: str, checkpoint: str, **columns: str):
    """A stream of changed pages, each micro-batch applied as one version."""
    return pages.writeStream.foreachBatch(lambda batch, epoch: apply(batch, path, **columns) and None).option("checkpointLocation", checkpoint)
