"""Best-two-fit packing of token pieces into sequences, by length classes.

Sequences are filled from a histogram of piece lengths, so the packing is global however many documents there are:
a *pattern* is a filled sequence, used as often as the histogram allows, and each pattern uses up one length at
least.  Filling is greedy (the largest length that fits); then the smallest document of the pattern is replaced by
two unpacked ones that fit the gap so widened more tightly.  The driver holds the histogram (``capacity`` numbers)
and the patterns (no more than lengths); pieces are numbered within their length and looked up, never gathered.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokenize import encoder

#: Columns of the piece table.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids and its end id, cut at ``capacity``.  ``nth``: number among the task's pieces of that length."""

    def run(batches):
        from pyspark import TaskContext

        task, enc, seen = TaskContext.get().partitionId(), encoder(path, spaced=False), {}
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, weigh=text_col):
            cols: list[list] = [[] for _ in range(8)]
            for doc, raw in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1).to_pylist())):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    n = len(part) // 4
                    nth = seen[n] = seen.get(n, -1) + 1
                    for c, v in zip(cols, (doc, k, at // 4, n, zlib.crc32(part), task, nth, part)):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)][: 8 if with_ids else 7], names[: 8 if with_ids else 7])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return kept.mapInArrow(run, PIECES + ", ids binary" * with_ids)


@dataclass
class Runs:
    """For each length, intervals of piece numbers: ``first`` of the interval, sequence base, uses a sequence, offset."""

    first: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    uses: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            n, r = int(lengths[own[0]]), ranks[own]
            k = np.searchsorted(self.first[n], r, side="right") - 1
            d = r - self.first[n][k]
            seq[own] = self.base[n][k] + d // self.uses[n][k]
            off[own] = self.offset[n][k] + d % self.uses[n][k] * n
        return seq, off


def fill(left: np.ndarray, capacity: int) -> list[int]:
    """One sequence from the counts ``left`` (index: length): greedily the largest that fits, then best-two-fit.

    ``left`` is not changed.  Returns the lengths used, largest first.
    """
    have = np.flatnonzero(left)
    used: dict[int, int] = {}
    got, gap = [], capacity
    while gap:
        k = int(np.searchsorted(have, gap, side="right")) - 1
        while k >= 0 and left[have[k]] <= used.get(int(have[k]), 0):
            k -= 1
        if k < 0:
            break
        n = int(have[k])
        take = min(gap // n, int(left[n]) - used.get(n, 0))
        got += [n] * take
        used[n] = used.get(n, 0) + take
        gap -= take * n
    if gap and len(got) > 1:
        small = got[-1]
        room, free = gap + small, left.copy()
        for n, u in used.items():
            free[n] -= u
        lengths = np.flatnonzero(free[: room + 1])
        best = (small, 0, 0)
        for a in lengths[::-1]:
            a = int(a)
            if 2 * a < best[0]:
                break
            k = int(np.searchsorted(lengths, min(room - a, a), side="right")) - 1
            if k >= 0 and int(lengths[k]) == a and free[a] < 2:
                k -= 1
            if k >= 0 and a + int(lengths[k]) > best[0]:
                best = (a + int(lengths[k]), a, int(lengths[k]))
                if best[0] == room:
                    break
        if best[1]:
            got = got[:-1] + [best[1], best[2]]
    return sorted(got, reverse=True)


def plan(counts: dict[int, int], capacity: int) -> Runs:
    """Patterns for a whole histogram: the largest unpacked length opens each, and each is repeated while its lengths last."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    total, rows, base = left.copy(), [], 0
    while left.any():
        pattern = fill(left, capacity)
        kinds, uses = np.unique(pattern, return_counts=True)
        times = int((left[kinds] // uses).min())
        offset = 0
        for n, u in zip(kinds[::-1].tolist(), uses[::-1].tolist()):
            rows.append((n, int(total[n] - left[n]), base, u, offset))
            offset += n * u
        left[kinds] -= uses * times
        base += times
    parts: dict[int, list] = {}
    for n, *rest in rows:
        parts.setdefault(n, []).append(rest)
    cols = {n: np.array(x, dtype=np.int64).reshape(-1, 4) for n, x in parts.items()}
    return Runs(*({n: c[:, i] for n, c in cols.items()} for i in range(4)), base)


def pack(table: DataFrame, capacity: int = 4096) -> DataFrame:
    """``table`` (from :func:`pieces`, written: its numbers must not change between reads) with sequence_id and offset."""
    spark = table.sparkSession
    by_task = table.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(by_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pack-starts")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    # The starts grow with the tasks: they are met by a merge join, never sent to every task.
    other = [c for c in table.columns if c not in ("task", "nth")]
    ranked = table.join(starts.select("task", "length", "before").hint("merge"), ["task", "length"]).select(*other, (F.col("nth") + F.col("before")).alias("rank"))

    def run(batches):
        for batch in batches:
            seq, off = runs.value.place(np.asarray(batch.column(batch.schema.get_field_index("length"))), np.asarray(batch.column(batch.schema.get_field_index("rank"))))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in other]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], [*other, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")


def best_two_fit(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents.  Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and its ids).

    A null or empty text is its end id alone; a null doc_id is packed like any other; repeated rows are packed once
    each; an empty table gives an empty result.  Only id and text are read.
    """
    return pack(materialize(pieces(docs, path, end_id, capacity, id_col, text_col, with_ids), "pack-pieces"), capacity)
