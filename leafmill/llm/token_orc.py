"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

ORC keeps each stripe's integers in its second run-length encoding, minima and maxima for every ``row.index.stride``
rows, and a Bloom filter of the document ids for the same rows.  Stripes are read in parallel by Spark's reader, and
a lookup of some documents skips the stripes and row groups whose metadata exclude them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, slices
from .tokenize import encoder

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 64, stride: int = 10_000) -> None:
    """Encode all texts and write them in ascending document order.

    ``part`` numbers the ordered partitions, ``part_start`` counts the ids of the same part before a document.
    Nulls: a null text is empty, null ids come first.  Rows with equal ids are ordered by a hash of their text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        part, start, enc, end = TaskContext.get().partitionId(), 0, encoder(tokenizer, spaced=True), np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, rows=1000, weigh="text"):
            raw = [x + end for x in enc.ids(batch.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in raw], dtype=np.int64)
            after = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], after]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(start + after - n), pa.array(n), ids], ["doc_id", "part", "part_start", "n_tokens", "ids"])
            start += int(after[-1])

    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(stride), "orc.stripe.size": str(stripe_mb << 20), "compression": "snappy"}
    ordered.mapInArrow(run, SCHEMA).write.options(**options).orc(path)


def _starts(table: DataFrame) -> DataFrame:
    """Ids before each part.  Only small columns are read; a part is as large as a task, so there are few."""
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents of an archive with their ids and ``start``, the number of ids of all documents before them."""
    table = spark.read.schema(SCHEMA).orc(path)
    return table.join(_starts(table), "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "ids")


def find(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The given documents only: the predicate reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of an archive, from the ids read; the ids themselves are not shuffled."""
    table = spark.read.schema(SCHEMA).orc(path)

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            values, offsets = np.ascontiguousarray(np.asarray(lists.values), dtype="<u4"), np.asarray(lists.offsets)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    read_back = table.select("doc_id", "part", "part_start", "ids").mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return read_back.join(_starts(table), "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, **options) -> DataFrame:
    """Write an archive in the shared folder and return what its files say of every document.

    An empty table gives an empty archive and result; extra columns are not read.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-orc")
    write(docs, tokenizer, end_id, path, **options)
    return digests(spark, path)
