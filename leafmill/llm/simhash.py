"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with numpy exclusive-or and bit counts, tile against tile.  A tile holds fingerprints
with the same population counts in each of ``parts`` equal slices of the 64 bits.  Flipping a bit moves one slice's
count by one, so two fingerprints within ``radius`` bits lie in tiles whose counts differ by ``radius`` in total at
most; every other pair of tiles is skipped unseen.  The comparison stays exact: no link is lost.
"""

from __future__ import annotations

from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import lower_words_of, materialize, remove

#: Fingerprints in a tile; larger groups of equal counts are split by hash into several tiles.
TILE = 1024


def fingerprint(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included; no words give 0."""
    if not words:
        return 0
    shingles = [words[i:] for i in range(min(width, len(words)))]
    if len(words) < width:
        shingles = [[b" ".join(words)]]
    n = max(1, len(words) - width + 1)
    joined = map(b" ".join, zip(*shingles)) if len(words) >= width else iter(shingles[0])
    hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(seed)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``(id_col, fp)`` for every row; ``fp`` holds the 64 bits in a signed long.  Null and empty texts give 0."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(lower_words_of(x.as_py()), width, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64())], [id_col, "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return kept.mapInArrow(run, f"`{id_col}` long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, by repeated minimum and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label) and np.array_equal(label[a], label[b]):
            break
    return label


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` between two tiles (``b`` None: inside one), thinned to a spanning forest.

    Every component that the links form stays connected, and a dense tile gives a link per fingerprint at most.
    """
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    step = max(1, (1 << 18) // max(1, len(other)))
    label = np.arange(len(nodes))
    for k in range(0, len(a), step):
        near = np.bitwise_count(a[k : k + step, None] ^ other[None, :]) <= radius
        if near.any():
            i, j = np.nonzero(near)
            label = _roots(len(nodes), np.concatenate([np.arange(len(nodes)), i + k]), np.concatenate([label, j + shift]))
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def _tile_pairs(rows: DataFrame, radius: int, parts: int, tile: int) -> DataFrame:
    """``x, y, own``: every two tiles of ``rows(fp, ...)`` that can hold fingerprints within ``radius``, as lists of the rows.

    Rows of ``fp`` alone are listed as plain numbers.
    """
    bits = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * bits).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))).cast("long") for i in range(parts)]
    key = sum((c * F.lit(128**i) for i, c in enumerate(counts[1:], 1)), counts[0])
    row = F.struct(*rows.columns) if len(rows.columns) > 1 else F.col("fp")
    keyed = rows.select(row.alias("row"), F.xxhash64(*rows.columns).alias("hash"), key.alias("tile"))
    sizes = keyed.groupBy("tile").agg(F.ceil(F.count("*") / tile).alias("split"))
    tiles = materialize(
        keyed.join(sizes, "tile").groupBy("tile", F.pmod("hash", "split").alias("piece")).agg(F.collect_list("row").alias("rows")), "simhash-tiles"
    )
    near = [o for o in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, o)) <= radius]
    steps = sorted(s for s in (sum(x * 128**i for i, x in enumerate(o)) for o in near) if s >= 0)
    left = tiles.select(F.col("tile").alias("at"), F.col("piece").alias("p"), F.col("rows").alias("x"))
    right = tiles.select(F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"), "tile", "piece", "rows")
    right = right.select((F.col("tile") + F.col("step")).alias("at"), (F.col("step") == 0).alias("same"), F.col("piece").alias("r"), F.col("rows").alias("y"))
    return left.join(right, "at").where(~F.col("same") | (F.col("p") <= F.col("r"))).select("x", "y", (F.col("same") & (F.col("p") == F.col("r"))).alias("own"))


def links(fps: DataFrame, radius: int = 3, parts: int = 4, tile: int = TILE) -> DataFrame:
    """``(a, b)`` links between different fingerprints of ``fps(fp)`` (unique values), a spanning forest per tile pair."""

    def run(batches):
        for batch in batches:
            xs, ys, out = batch.column(0), batch.column(1), []
            flat = [(np.asarray(c.values).view(np.uint64), np.asarray(c.offsets)) for c in (xs, ys)]
            for k, own in enumerate(batch.column(2).to_pylist()):
                x, y = (v[o[k] : o[k + 1]] for v, o in flat)
                found = tile_links(x, None if own else y, radius)
                if len(found[0]):
                    out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out)], ["a", "b"])

    return _tile_pairs(fps.select("fp"), radius, parts, tile).mapInArrow(run, "a long, b long")


def links_apart(rows: DataFrame, radius: int = 3, parts: int = 4, tile: int = TILE) -> DataFrame:
    """``(a, b)``: all pairs of ``rows(fp, ident, root, n)`` within ``radius`` whose ``root`` differs, ``a < b``.

    Nothing is thinned but pairs of sizes (``n``) below four to five, which no sets of Jaccard 0.8 have.
    """

    def run(batches):
        for batch in batches:
            sides = [([np.asarray(c.values.field(i)) for i in range(4)], np.asarray(c.offsets)) for c in (batch.column(0), batch.column(1))]
            for k, own in enumerate(batch.column(2).to_pylist()):
                (f, a, r, n), (g, b, s, m) = ([v[o[k] : o[k + 1]] for v in vs] for vs, o in sides)
                step = max(1, (1 << 18) // max(1, len(g)))
                for at in range(0, len(f), step):
                    cut = slice(at, at + step)
                    near = (np.bitwise_count(f[cut, None].view(np.uint64) ^ g[None, :].view(np.uint64)) <= radius) & (r[cut, None] != s[None, :])
                    near &= 5 * np.minimum(n[cut, None], m[None, :]) >= 4 * np.maximum(n[cut, None], m[None, :])
                    i, j = np.nonzero(near)
                    low, high = np.minimum(a[cut][i], b[j]), np.maximum(a[cut][i], b[j])
                    once = (a[cut][i] < b[j]) if own else low < high
                    if once.any():
                        yield pa.RecordBatch.from_arrays([pa.array(low[once]), pa.array(high[once])], ["a", "b"])

    kept = rows.select("fp", F.col("ident").cast("long").alias("ident"), F.col("root").cast("long").alias("root"), F.col("n").cast("long").alias("n"))
    return _tile_pairs(kept, radius, parts, tile).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the least node of each connected component, by alternating large and small stars.

    Each round is a partial minimum and a join on the node, both spread over the cluster; hubs are met by
    map-side combination and skew-join splitting.  The rounds grow with the logarithm of the longest path.
    """
    edge = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "links")
    mark = None
    while True:
        both = edge.union(edge.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = materialize(large, "links")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).where("u < v").distinct()
        small = materialize(small, "links")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        remove(edge)
        remove(large)
        edge = small
        if now == mark:
            return edge.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = now


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, parts: int = 4, seed: int = 42) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; repeated rows come out once each; a null id
    never becomes a component's id unless the component has no other; an empty table gives an empty result.  Only
    the id and the text are read, so further columns may have any name.
    """
    rows = materialize(with_fingerprints(docs, id_col, text_col, width, seed), "simhash-fps")
    unique = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-unique")
    root = components(links(unique.select("fp"), radius, parts))
    members = unique.join(root, unique.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(members.join(heads, "root").select(F.col("fp").alias("of"), "component_id"), "simhash-components")
    return rows.join(of, rows.fp == of.of).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents whose id is the smallest of their near-duplicate group, with the columns of ``docs``.

    Rows that share the smallest id all stay; rows with a null id have no group and stay.
    """
    found = simhash_components(docs, id_col, **options)
    later = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__later")).distinct()
    return docs.join(later, docs[id_col] == later["__later"], "left_anti")
