"""Two-pass external shuffle into shards.

Pass one scatters records by seeded hashes: the document id alone decides the shard, by the highest of one hash per
shard, so a further shard takes records only into itself; a second hash scatters a shard's records uniformly into
buckets of about ``bucket_mb``.  Pass two reads one bucket at a time into memory, shuffles it by Fisher-Yates with
the bucket's own seed, and writes it; buckets follow each other in the shard, so slots are gapless.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, unsigned


def shard_of(id_col: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash of the id is highest (rendezvous hashing)."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(id_col, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))["s"]


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: position i changes places with one of i..n-1, from the first on."""
    order = list(range(n))
    for i, j in enumerate(rng.integers(np.arange(n), n).tolist() if n else []):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffle(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_mb: float = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``shard, bucket, slot, grown_shard`` and its columns; the order within a bucket is by slot.

    Null ids share one shard, which has as many buckets as its bytes need; a null text has no bytes; rows equal in id and
    text are interchangeable and share a bucket.  Columns named
    like the added ones are replaced.
    """
    added = ("shard", "bucket", "slot", "grown_shard")
    rows = docs.drop(*added)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8
    key = F.col(id_col)
    rows = rows.withColumn("shard", shard_of(key, shards, seed)).withColumn("__tie", F.xxhash64(key, F.col(text_col), F.lit(seed)))
    # One row a shard: a shard that holds more (ids that occur often) is cut into more buckets.
    held = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum(size).alias("bytes")).collect()}
    buckets = F.array(*[F.lit(max(1, round(held.get(k, 0) / (bucket_mb * 2**20)))) for k in range(shards)])
    rows = rows.withColumn("bucket", F.pmod("__tie", F.get(buckets, F.col("shard"))).cast("int"))
    rows = rows.withColumn("grown_shard", F.when(F.xxhash64(key, F.lit(seed), F.lit(shards)) > F.xxhash64(key, F.lit(seed), F.col("shard")), F.lit(shards)).otherwise(F.col("shard")))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "shard-starts")

    out = [f for f in rows.schema if f.name not in ("__tie",)]
    names = [f.name for f in out]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", slot long"

    def run(key, left, right):
        shard, bucket = (k.as_py() for k in key)
        if not left.num_rows:
            return left.select(names).append_column("slot", pa.array([], pa.int64()))
        canonical = left.sort_by([("__tie", "ascending"), (id_col, "ascending")]).select(names)
        order = fisher_yates(left.num_rows, np.random.default_rng([seed, shard, bucket]))
        start = right.column("before")[0].as_py()
        return canonical.take(pa.array(order)).append_column("slot", pa.array(np.arange(start, start + len(order))))

    return rows.groupBy("shard", "bucket").cogroup(starts.groupBy("shard", "bucket")).applyInArrow(run, types)


def write(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled shards, a folder each; a file holds whole buckets in slot order."""
    shuffle(docs, **options).write.partitionBy("shard").parquet(path)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the shards in the shared folder and return each record's place, size and checksum as read from them."""
    spark: SparkSession = docs.sparkSession
    path = new_path(spark, "shards")
    placed = shuffle(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    placed.write.partitionBy("shard").parquet(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return spark.read.schema(placed.schema).parquet(path).select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), unsigned(text).alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"), "bucket"
    )
