"""Small operators on records: look-ups, leases, states of groups, matches by rank, paragraphs, pieces, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .library import islands

#: Letters, digits and the marks that stay with an Arabic word (fixed values: vowel signs, superscript alef, tatweel).
WORD_CLASS = r"\p{L}\p{N}_\x{064B}-\x{065F}\x{0670}\x{0640}"


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with this key; LookupError where there is none.  The predicate reaches the scan."""
    found = rows.where(F.col(key) == value).limit(1)
    if found.isEmpty():
        raise LookupError(f"no row with {key} = {value!r}")
    return found


def held(claimed: Column, now: Column, hours: int) -> Column:
    """A lease younger than ``hours`` holds; one never claimed does not."""
    return F.coalesce(claimed > now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))


def change_state(total: Column, doubtful: Column, reviewed: Column) -> Column:
    """State of a change by the counts of its words: all doubtful, any reviewed, none; null without words."""
    return F.when(total > 0, F.when(doubtful == total, "doubtful").when(reviewed > 0, "reviewed").otherwise("unreviewed"))


def match_in_order(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """One-to-one: the nth of a key on the left meets the nth on the right; every left row, with nulls where there is none.

    This is what taking the first unused right row gives, left rows in order: only rows of one key compete.
    """
    nth = lambda df, order: df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return nth(left, left_order).join(nth(right, right_order), [*keys, "__nth"], "left").drop("__nth")


def match_by_rank(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One-to-one: the nth of a key on the left meets the nth on the right; ``left_id``, ``right_id`` (null: none)."""
    ranked = lambda df, name: df.select(*keys, F.col(order).alias(name), F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("rank"))
    return ranked(left, "left_id").join(ranked(right, "right_id"), [*keys, "rank"], "left")


def paragraphs(lines: DataFrame, key: str, order: str, role: str, short: Column, heading: str) -> DataFrame:
    """``paragraph``: a new one begins where the role changes or the line before was short; headings run on."""
    w = Window.partitionBy(key).orderBy(order)
    before, was_short = F.lag(role).over(w), F.lag(short).over(w)
    begins = before.isNull() | (before != F.col(role)) | ((F.col(role) != heading) & was_short)
    return islands(lines.withColumn("__begins", begins), [key], order, F.col("__begins"), "paragraph").drop("__begins")


def split_pieces(text: Column) -> Column:
    """Per white-space token the runs of word characters and of others, as an array of arrays."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(f"[{WORD_CLASS}]+|[^{WORD_CLASS}]+"), 0))


def fingerprint(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """SHA-1 of a group's values in order; equal for equal rows, however they are partitioned."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return rows.groupBy(key).agg(F.sha1(F.array_join(ordered, ",").cast("binary")).alias("fingerprint"))


def span_state(reviewed: Column) -> Column:
    """Aggregate state of a span's words: all reviewed, some, none."""
    return F.when(F.bool_and(reviewed), "reviewed").when(F.bool_or(reviewed), "partly_reviewed").otherwise("unreviewed")
