"""Streaming counterparts: idempotent consumption, trailing rate limits, incremental index upkeep, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as I


def consume_once(events: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """The first event of each key; state is dropped behind the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def call_rates(events: DataFrame, key: str, ts: str, limit: int = 60, delay: str = "1 minute") -> DataFrame:
    """Calls a key in sliding minutes, and whether they reach the limit."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, "1 minute", "10 seconds").alias("w"), key).agg(F.count("*").alias("calls"))
    return counted.select(F.col("w.end").alias("until"), key, "calls", (F.col("calls") >= limit).alias("limited"))


def usage_windows(events: DataFrame, ts: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Extension: tumbling windows of counts and sums by event type, late data dropped behind the watermark."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def maintain_index(pages: DataFrame, path: str, checkpoint: str, page: str = "page_id", book: str = "book", text: str = "text"):
    """Keeps a Parquet index by ``book`` up to date from a stream of changed pages; only touched books are rewritten.

    A batch writes the merged rows of its books to a folder of their own before they replace the old ones, book by book: a
    batch that fails while it replaces them leaves some books new and some old until it is run again
    (:mod:`.snapshots` has no such moment).  The last text of a page in a batch counts; an empty text drops its row.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(page, book).agg(F.max_by(text, "version").alias(text))
        fresh = I.index_pages(last, page, book, text).select(page, "norm", "norms", "raws", book)
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            touched = last.select(book).distinct()
            old = spark.read.schema(fresh.schema).parquet(path).join(touched, book, "left_semi")
            fresh = I.refresh(old, last, fresh, page)
        staged = f"{path}-batches/{epoch}"
        fresh.write.mode("overwrite").parquet(staged)
        spark.read.schema(fresh.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(book).parquet(path)
        # A book that has lost its last page is no partition of the batch: its folder goes.
        left = spark.read.schema(fresh.schema).parquet(staged).select(book).distinct()
        for row in last.select(book).distinct().join(left, book, "left_anti").toLocalIterator():
            name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(row[0]))
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{book}={name}"), True)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
