"""The change plan against a plain version, and an index whose batches die at any step."""

import pytest

from leafmill.functions.sequence import merge3
from leafmill.operators import changes as C
from leafmill.plans import books
from leafmill.streaming import snapshots

SCHEMA = "book string, side string, block long, lines array<long>, page long, words array<string>"


def plain_plan(blocks, known, read, added):
    """Union-find over blocks by line, then the decision table."""
    up = {(s, b): (s, b) for _, s, b, lines, _, _ in blocks if lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    owner = {}
    for _, s, b, lines, _, _ in blocks:
        for line in lines or []:
            if line in owner:
                up[root((s, b))] = root(owner[line])
            else:
                owner[line] = (s, b)
    groups: dict = {}
    for r in blocks:
        if r[3]:
            groups.setdefault(root((r[1], r[2])), []).append(r)
    at = {(r[1], r[2]): k for k, g in groups.items() for r in g}
    fresh = sorted(r[2] for r in blocks if r[1] == "f" and r[3])
    out = []
    for k, g in groups.items():
        pages = {r[4] for r in g}
        if not pages & read:
            continue
        side = {s: sorted((r[2], r[5]) for r in g if r[1] == s) for s in "mbf"}
        t = {s: [w for _, words in side[s] for w in [*words, C.BREAK]] for s in "mbf"}
        m, b, f, ok, new = t["m"], t["b"], t["f"], pages <= known, bool(pages & added)
        merged, conflicts = None, 0
        if m == f:
            continue
        if not m:
            if ok and b:
                if b == f:
                    continue
                what = "conflict"
            else:
                what = "insert" if ok or new else "choose"
        elif not f:
            what = ("remove" if m == b else "conflict") if ok else "choose"
        elif not ok:
            what = "choose"
        elif m == b:
            what = "take"
        elif f == b:
            continue
        else:
            words, conflicts = merge3(b, m, f)
            if not conflicts and words == m:
                continue
            what = "conflict" if conflicts else "merged"
            merged = None if conflicts else " ".join(words)
        anchor = None
        own = [x for x, _ in side["f"]]
        if own and not side["m"]:
            mine = lambda x: [r[2] for r in groups[at["f", x]] if r[1] == "m"]
            before = [max(mine(x)) for x in fresh if x < own[0] and mine(x)]
            after = [min(mine(x)) for x in fresh if x > own[-1] and mine(x)]
            anchor = f"after {before[-1]}" if before else f"before {after[0]}" if after else None
        out.append((*[[x for x, _ in side[s]] for s in "mbf"], what, merged, conflicts, anchor))
    return out


def test_query_equals_the_plain_version(spark, sf):
    rows = [tuple(r) for r in books._bodies(spark, sf).collect()]
    pages = {r[4] for r in rows}
    known, read, added = {p for p in pages if p % 10}, {p for p in pages if p % 3}, {p for p in pages if p % 29 == 0}
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = [(book, *x) for book, own in by.items() for x in plain_plan(own, known, read, added)]
    of = lambda pages: spark.createDataFrame([(r[0], r[4]) for r in rows if r[4] in pages], "book long, page long")
    got = C.plan(books._bodies(spark, sf), of(known), of(read), of(added)).collect()
    assert sorted(((r["book"], r["mine"], r["base"], r["fresh"], r["decision"], r["merged"], r["conflicts"], r["anchor"]) for r in got), key=repr) == sorted(want, key=repr)
    assert {w[4] for w in want} >= {"take", "merged", "conflict", "choose", "insert"}


def test_blocks_split_and_joined_are_one_cluster(spark):
    rows = [("x", "m", 0, [1, 2], 1, ["a", "b"]), ("x", "b", 0, [1], 1, ["a"]), ("x", "b", 1, [2], 1, ["b"]), ("x", "f", 0, [1], 1, ["a"]), ("x", "f", 1, [2, 3], 1, ["b", "c"]), ("x", "f", 2, [9], 1, ["new"]), ("x", "m", 1, [], 1, ["no lines"]), ("x", "m", 2, None, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    page = spark.createDataFrame([("x", 1)], "book string, page long")
    assert C.clusters(df).select("cluster").distinct().count() == 2
    got = {tuple(r["fresh"]): (r["mine"], r["decision"], r["merged"], r["anchor"]) for r in C.plan(df, page, page).collect()}
    assert got[(2,)] == ([], "insert", None, "after 0")
    assert got[(0, 1)][:2] == ([0], "conflict") or got[(0, 1)][1] == "merged"
    assert C.plan(df.limit(0), page, page).count() == 0


class Killed(Exception):
    pass


def texts(spark, path):
    df = snapshots.read(spark, path)
    return {} if df is None else {r["page_id"]: r["norm"] for r in df.collect()}


@pytest.mark.parametrize("step", ["rows", "version", "pointer"])
def test_a_batch_that_dies_leaves_the_index_as_it_was(spark, tmp_path, step):
    path, schema = f"file://{tmp_path}/ix", "page_id long, book string, text string, version int"
    first = spark.createDataFrame([(1, "a", "alpha beta", 1), (2, "a", "gamma", 1), (3, "01", "delta", 1), (4, None, "no book", 1)], schema)
    second = spark.createDataFrame([(2, "a", "gamma new", 2), (2, "a", "gamma old", 1), (3, "01", "", 2), (5, "c/d e", "epsilon", 1)], schema)

    def die(at):
        if at == step:
            raise Killed

    with pytest.raises(Killed):
        snapshots.apply(first, path, on_step=die)
    assert texts(spark, path) == {}
    snapshots.apply(first, path)
    before = {1: "alpha beta", 2: "gamma", 3: "delta", 4: "no book"}
    assert texts(spark, path) == before
    with pytest.raises(Killed):
        snapshots.apply(second, path, on_step=die)
    assert texts(spark, path) == before
    for _ in range(2):  # a retried batch gives the same index
        snapshots.apply(second, path)
        assert texts(spark, path) == {1: "alpha beta", 2: "gamma new", 4: "no book", 5: "epsilon"}
    assert snapshots.vacuum(spark, path) > 0 and snapshots.vacuum(spark, path) == 0
    assert texts(spark, path) == {1: "alpha beta", 2: "gamma new", 4: "no book", 5: "epsilon"}


def test_books_that_lose_all_pages_and_streams(spark, tmp_path):
    path, schema = f"file://{tmp_path}/ix", "page_id long, book string, text string, version int"
    src = f"file://{tmp_path}/in"
    for rows in ([(1, "a", "", 1)], [(1, "a", "alpha", 2), (2, "b", "beta", 1)], [(1, "a", "", 3)], [(2, "b", None, 3)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        q = snapshots.maintain(spark.readStream.schema(schema).parquet(src), path, f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert texts(spark, path) == {}


def test_blocks_of_the_same_lines_make_no_edges(spark, monkeypatch):
    from leafmill.operators import changes as C

    rows = [("k", s, 1, [1, 2, 2]) for s in "mbf"] + [("k", "m", 5, [5, 6]), ("k", "b", 5, [5]), ("k", "b", 6, [6]), ("k", "f", 9, [])]
    seen, whole = [], C.components
    monkeypatch.setattr(C, "components", lambda edges, a, b: seen.append(edges.count()) or whole(edges, a, b))
    got = {(r["side"], r["block"]): r["cluster"] for r in C.clusters(spark.createDataFrame(rows, "book string, side string, block long, lines array<long>")).collect()}
    assert seen == [2]
    assert got == {("m", 1): "k/b/1", ("b", 1): "k/b/1", ("f", 1): "k/b/1", ("m", 5): "k/b/5", ("b", 5): "k/b/5", ("b", 6): "k/b/5"}
