"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping probes.  A text that holds a probe within ``e`` edits shares at least
``L - q + 1 - q * e`` of its q-grams with it (the q-gram lemma), all in a diagonal band.  A document is first scanned
for stretches dense enough in benchmark q-grams of any kind; there, shared q-grams are counted by probe in
overlapping diagonal bands; what meets the bound is verified by banded alignment.  None of the steps loses a match.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, slices

#: ASCII punctuation becomes a space.
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalize(text: str | None) -> bytes:
    """Lower case, punctuation and white space as single spaces, UTF-8, a space at both ends."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()) + b" "


@dataclass(frozen=True)
class Settings:
    """Probes of ``window`` bytes every ``step``; ``rate`` edits a byte; q-grams of ``q`` bytes (8 at most)."""

    window: int = 100
    step: int = 50
    rate: float = 0.06
    q: int = 8

    def budget(self, length: int) -> tuple[int, int]:
        """Edits allowed for a probe of this length and the shared q-grams that the lemma then asks for, 1 at least."""
        e = int(self.rate * length)
        while e and length - self.q + 1 - self.q * e < 1:
            e -= 1
        return e, max(1, length - self.q + 1 - self.q * e)


def grams(text: bytes, q: int) -> np.ndarray:
    """All q-grams of a text as integers."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    view = np.ndarray((n,), dtype="<u8", buffer=text + bytes(8), strides=(1,))
    return view.copy() if q == 8 else view & np.uint64((1 << 8 * q) - 1)


class Index:
    """Probes of a block of benchmark items with their q-grams."""

    def __init__(self, items: list[tuple[int, str | None]], settings: Settings = Settings()):
        self.s = s = settings
        self.probes: list[bytes] = []
        self.item: list[int] = []
        self.short: list[tuple[int, bytes]] = []
        for ident, text in items:
            norm = normalize(text)
            if len(norm) < s.q:
                if len(norm) > 2:
                    self.short.append((ident, norm))
                continue
            last = max(0, len(norm) - s.window)
            for at in sorted({*range(0, last + 1, s.step), last}):
                self.probes.append(norm[at : at + s.window])
                self.item.append(ident)
        self.length = np.array([len(p) for p in self.probes], dtype=np.int64)
        self.edits, self.need = (np.array(x, dtype=np.int64) for x in (zip(*map(s.budget, self.length.tolist())) if self.probes else ((), ())))
        each = [grams(p, s.q) for p in self.probes]
        flat = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.probe_of = np.repeat(np.arange(len(each)), [len(g) for g in each])[order]
        self.offset_of = (np.concatenate([np.arange(len(g)) for g in each]) if each else np.zeros(0, dtype=np.int64))[order]
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat))
        self.bits = 22
        self.some = np.zeros(1 << self.bits, dtype=bool)
        self.some[self._slot(self.grams)] = True
        self.least = int(self.need.min()) if len(self.need) else 1
        self.reach = int((self.length + 2 * self.edits).max()) if len(self.length) else 1

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def stretches(self, hit: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of positions that windows of ``reach`` with at least ``least`` hits cover."""
        n, w = len(hit), self.reach
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        starts = np.flatnonzero(sums[np.minimum(np.arange(n) + w, n)] - sums[:-1] >= self.least)
        if len(starts):
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > w) + 1):
                yield int(run[0]), min(n, int(run[-1]) + w)

    def matches(self, text: str | None) -> dict[int, int]:
        """Items found in a text, with the fewest edits of any of their probes."""
        norm = normalize(text)
        out = {i: 0 for i, t in self.short if t in norm}
        g = grams(norm, self.s.q)
        if not len(g) or not self.probes:
            return out
        hit = self.some[self._slot(g)]
        near = [a + np.flatnonzero(hit[a:b]) for a, b in self.stretches(hit)]
        if not near:
            return out
        pos = np.concatenate(near)
        at = np.searchsorted(self.grams, g[pos])
        at[at == len(self.grams)] = 0
        same = self.grams[at] == g[pos]
        pos, at = pos[same], at[same]
        many = self.last[at] - self.first[at]
        pos = np.repeat(pos, many)
        occ = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(len(pos))
        probe, off = self.probe_of[occ], self.offset_of[occ]
        band = np.floor_divide(pos - off, np.maximum(self.edits[probe], 1)) + self.s.window + 1  # no band is below 0
        bands, places = len(norm) + self.s.window + 3, self.s.window + 1
        key = (probe * bands + band) * places + off
        key = np.unique(np.concatenate([key, key - places]))  # a q-gram of a probe counts once in each of its two bands
        pair, count = np.unique(key // places, return_counts=True)
        pair = pair[count >= self.need[pair // bands]]
        for p, d in zip(*self.verify(norm, pair // bands, pair % bands - self.s.window - 1)):
            i = self.item[p]
            out[i] = min(d, out.get(i, d))
        return out

    def verify(self, norm: bytes, probe: np.ndarray, band: np.ndarray) -> tuple[list[int], list[int]]:
        """Probes whose least edit distance to a place in the band is within their budget, and that distance."""
        found: tuple[list[int], list[int]] = ([], [])
        text = np.frombuffer(norm, dtype=np.uint8)
        for n in np.unique(self.length[probe]).tolist():
            own = probe[self.length[probe] == n]
            e = int(self.edits[own[0]])
            wide = max(e, 1)
            left = band[self.length[probe] == n] * wide - e  # the lowest diagonal of the alignment's band
            width = 2 * wide + 2 * e + 1
            cells = left[:, None] + np.arange(n + width)[None, :]
            rows = np.where((cells >= 0) & (cells < len(text)), text[np.clip(cells, 0, len(text) - 1)], 0)
            want = np.frombuffer(b"".join(self.probes[p] for p in own), dtype=np.uint8).reshape(len(own), n)
            dist = banded(want, rows, width)
            for p, d in zip(own.tolist(), dist.tolist()):
                if d <= e:
                    found[0].append(p)
                    found[1].append(d)
        return found


def banded(probe: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Edit distance of each probe to the best place of its text row, along ``width`` diagonals; ends are free.

    Column k of row i stands for the text before place i + k.  Row 0 is free; the last row's least value counts.
    """
    steps = np.arange(width)
    cost = np.zeros((len(probe), width), dtype=np.int64)
    for i in range(probe.shape[1]):
        new = cost + (text[:, i : i + width] != probe[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
    return cost.min(axis=1)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, str | None]]]:
    """The stated query set in blocks of at most ``most`` bytes (or one item), streamed through the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).distinct().toLocalIterator():
        if block and size + len(r[1]) > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


#: The index in use, by the broadcast it was built from: one a worker.
_INDEXES: dict[str, Index] = {}


def _index(ident: str, shared, settings: Settings) -> Index:
    if ident not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[ident] = Index(shared.value, settings)
    return _INDEXES[ident]


def _scan(docs: DataFrame, items: list, settings: Settings, only_found: bool) -> DataFrame:
    shared, ident = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        index = _index(ident, shared, settings)
        for batch in slices(batches, weigh="text"):
            keys = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())
            rows = [(i, t, sorted(m, key=lambda k: (k is None, k)), min(m.values(), default=None)) for (i, t), m in zip(keys, map(index.matches, batch.column(1).to_pylist())) if m or not only_found]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.int32())], ["doc_id", "tid", "item_ids", "edits"])

    return docs.mapInArrow(run, "doc_id long, tid long, item_ids array<long>, edits int")


def contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, contaminated, item_ids, edits`` for every document, over the whole benchmark.

    ``item_ids`` lists the items found in ascending order, one without an id as null at the end, ``edits`` is the least distance of a probe (null: none).
    Null and empty texts are clean; a null doc_id is judged like any other; items without text match nothing, and
    items under ``q`` bytes match exactly as whole words; an empty table gives an empty result.  Each row is judged by
    its own text, whatever its id and however many blocks of items there are.  Only id and text are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tid", F.xxhash64("text"))  # with the id it names a row among the hits of several blocks
    found: list[DataFrame] = []
    blocks = item_blocks(benchmark, item_col, item_text, block_bytes)
    block, after = next(blocks, []), next(blocks, None)
    if after is None:
        out = _scan(rows, block, settings, only_found=False)
    else:
        while block:
            found.append(materialize(_scan(rows, block, settings, only_found=True), "contaminated"))
            block, after = after, next(blocks, None)
        hits = found[0]
        for more in found[1:]:
            hits = hits.union(more)
        hits = hits.groupBy(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.min("edits").alias("edits"))
        out = rows.select("doc_id", "tid").join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tid") == F.col("__tid")), "left").select("doc_id", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "edits")
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "edits")


def _clean(docs: DataFrame, items: list, settings: Settings, text_col: str) -> DataFrame:
    shared, ident = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        index = _index(ident, shared, settings)
        for batch in slices(batches, weigh=text_col):
            yield batch.filter(pa.array([not index.matches(x) for x in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), block_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a benchmark passage, with the columns of ``docs``.

    Every row is judged by its own text in the scan, whatever its id.  Further blocks of items scan what is left.
    """
    out, written = docs, None
    blocks = item_blocks(benchmark, item_col, item_text, block_bytes)
    block, after = next(blocks, []), next(blocks, None)
    while after is not None:
        left = materialize(_clean(out, block, settings, text_col), "clean")
        if written is not None:
            remove(written)
        out = written = left
        block, after = after, next(blocks, None)
    return _clean(out, block, settings, text_col)
