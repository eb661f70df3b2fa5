import numpy as np
import pytest
from xxhash import xxh64_intdigest

from leafmill.llm import queries, simhash

from .helpers import AWKWARD_SCHEMA, awkward


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    """fps: list of (id, fingerprint) with ids; union-find over all pairs of different fingerprints."""
    unique = sorted({f for _, f in fps})
    up = {f: f for f in unique}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    arr = np.array(unique, dtype=np.uint64)
    for f in unique:
        for g in arr[np.bitwise_count(arr ^ np.uint64(f)) <= radius].tolist():
            up[root(f)] = root(g)
    low = {}
    for i, f in fps:
        if i is not None:
            low[root(f)] = min(i, low.get(root(f), i))
    return {(i, f): low.get(root(f)) for i, f in fps}


def check(df, result):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in result.collect()]
    assert sorted(map(str, got)) == sorted(str((i, f, want[i, f])) for i, f in rows)
    assert all(len(r["fingerprint"]) == 16 for r in result.take(3))


def test_query_equals_brute_force(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), queries.op10_simhash(spark, sf))


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), AWKWARD_SCHEMA)
    check(df, simhash.simhash_components(df))
    assert simhash.simhash_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [2, 4])
def test_links_lose_nothing_among_chains_and_dense_groups(spark, parts):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    near = [int(b) ^ int(sum(1 << int(x) for x in rng.choice(64, k, replace=False))) for b in base for k in (1, 2, 3, 4, 5)]
    chain = [0]
    for i in range(0, 60, 3):
        chain.append(chain[-1] ^ (7 << i))
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in [*map(int, base), *near, *chain]})
    rows = [(i, f % 2**64) for i, f in enumerate(fps)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, parts, tile=8)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(root.get(f, f), []).append(i)
    got = {i: min(g) for g in groups.values() for i in g}
    assert got == {i: c for (i, _), c in brute_components(rows).items()}


def test_keep_one_leaves_one_of_each_group(spark):
    df = spark.createDataFrame([(3, "a b c d", "x"), (1, "A b c d", "y"), (2, None, "z"), (5, "", "w"), (7, "quite another text", "v")], "doc_id long, text string, lang string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 7]
