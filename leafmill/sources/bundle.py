"""Book bundles and text exports: JSON lines with a manifest, id remapping, and joined texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layout written and understood.
FORMAT, VERSION = "leafmill-bundle", 1


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines and, last, a manifest with the row counts: a bundle without one is incomplete."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
        found, there = spark.read.schema(df.schema).json(f"{path}/{name}").count(), df.count()
        if found != there:
            raise ValueError(f"{name}: {found} of {there} rows were written")
        counts.append((FORMAT, VERSION, name, there, df.schema.json()))
    spark.createDataFrame(counts, "format string, version int, name string, rows long, schema string").coalesce(1).write.json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle whose manifest fits its files."""
    from pyspark.sql.types import StructType
    import json

    out = {}
    for row in spark.read.schema("format string, version int, name string, rows long, schema string").json(f"{path}/manifest").collect():
        if row["format"] != FORMAT or row["version"] > VERSION:
            raise ValueError(f"{row['format']} {row['version']} cannot be read")
        df = spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).json(f"{path}/{row['name']}")
        if df.count() != row["rows"]:
            raise ValueError(f"{row['name']} is not complete")
        out[row["name"]] = df
    return out


def remap(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` replaced by ``ids(old, new)``; an id without a successor becomes null."""
    return df.join(ids, df[column] == ids["old"], "left").withColumn(column, F.col("new")).drop("old", "new")


def export_books(pages: DataFrame, book: str, number: str, final: str, provisional: str) -> DataFrame:
    """One text per book: its non-empty pages in order, the final text before the provisional one, by blank lines."""
    text = F.coalesce(F.nullif(F.trim(final), F.lit("")), F.nullif(F.trim(provisional), F.lit("")))
    rows = pages.select(book, number, text.alias("t")).where("t IS NOT NULL")
    return rows.groupBy(book).agg(F.array_join(F.sort_array(F.collect_list(F.struct(number, "t")))["t"], "\n\n").alias("text"))


def write_summary(df: DataFrame, path: str) -> None:
    """A CSV summary with a header, in one file."""
    df.coalesce(1).write.option("header", True).csv(path)
