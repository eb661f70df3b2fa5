import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import decontaminate as dc
from leafmill.llm import queries

from .helpers import AWKWARD_SCHEMA, awkward


def best_place(probe, text):
    """Least edit distance of ``probe`` to any part of ``text``: the plain full table."""
    row = np.zeros(len(text) + 1, dtype=int)
    steps = np.arange(len(text) + 1)
    t = np.frombuffer(text, dtype=np.uint8)
    for i, c in enumerate(probe):
        new = np.concatenate([[i + 1], row[:-1] + (t != c)])
        new = np.minimum(new, row + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def brute(items, text, s=dc.Settings()):
    norm, out = dc.normalize(text), {}
    for i, t in items:
        item = dc.normalize(t)
        if len(item) <= 2:
            continue
        if len(item) < s.q:
            if item in norm:
                out[i] = 0
            continue
        last = max(0, len(item) - s.window)
        for at in {*range(0, last + 1, s.step), last}:
            probe = item[at : at + s.window]
            d = best_place(probe, norm)
            if d <= s.budget(len(probe))[0] and len(norm) >= s.q:
                out[i] = min(d, out.get(i, d))
    return out


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False))
def test_index_equals_full_alignment(rng):
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 6)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(5)]
    text = list(" ".join(word() for _ in range(20)) + " " + " ".join(t[rng.randrange(0, len(t) + 1) // 2 :] for _, t in rng.sample(items, 2)) + " " + word())
    for _ in range(rng.randrange(0, 12)):
        k = rng.randrange(len(text))
        text[k : k + rng.randrange(0, 2)] = rng.choice(["", "a", "zz", " "])
    text = "".join(text)
    assert dc.Index(items).matches(text) == brute(items, text)


def test_query_equals_brute_force(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op3_qgram_decontamination(spark, sf).collect()}
    assert got.keys() == docs.keys() and any(r["contaminated"] for r in got.values())
    for i in [*sorted(docs)[:25], *[i for i, r in got.items() if r["contaminated"]][:10]]:
        if len(docs[i]) < 5000:
            want = brute(items, docs[i])
            assert got[i]["item_ids"] == sorted(want) and got[i]["edits"] == min(want.values(), default=None), i
    for i, r in got.items():  # whole items
        exact = {k for k, t in items if dc.normalize(t) in dc.normalize(docs[i])}
        assert exact <= set(r["item_ids"])


def test_awkward_rows_blocks_and_filter(spark):
    rng = random.Random(2)
    passage = " ".join(rng.choice(["alpha", "bravo", "charlie", "delta", "echo", "fox"]) + str(rng.randrange(99)) for _ in range(40))
    rows = awkward() + [(900, "Before it. " + passage.upper().replace(" ", "\n") + " After.", "en", "s", 1, 1, 1, 1, 1), (901, passage[:150].replace("7", "8", 2), "en", "s", 1, 1, 1, 1, 1), (902, passage[:60], "en", "s", 1, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, AWKWARD_SCHEMA)
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "  \n"), (5, "zq")] + [(1, passage)], "item_id long, text string")
    one = dc.contamination(docs, bench)
    assert {r["doc_id"] for r in one.where("contaminated").collect()} == {900, 901}
    two = dc.contamination(docs, bench, block_bytes=1)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert dc.keep_clean(docs, bench).columns == docs.columns
    assert dc.keep_clean(docs, bench).count() == len(rows) - 2
    assert dc.contamination(docs.limit(0), bench).collect() == [] and not dc.contamination(docs, bench.limit(0)).where("contaminated").count()


def test_filter_judges_rows_not_ids(spark):
    passage = " ".join(f"word{k}x{k * k % 97}" for k in range(40))
    rows = [(None, passage), (None, "a clean text without an id"), (None, None), (4, "clean under a shared id"), (4, "before " + passage), (5, "other " + passage[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, passage[::-1])], "item_id long, text string")
    for block in (8 << 20, 1):
        assert sorted(str(r["text"]) for r in dc.keep_clean(docs, bench, block_bytes=block).collect()) == ["None", "a clean text without an id", "clean under a shared id"]


def test_items_without_an_id(spark):
    first, second = (" ".join(f"{c}{k}x{k * k % 97}" for k in range(40)) for c in ("word", "other"))
    docs = spark.createDataFrame([(1, f"{first} and {second}"), (2, first), (3, second), (4, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, first), (1, second), (None, None)], "item_id long, text string")
    for block in (8 << 20, 1):
        got = {r["doc_id"]: r["item_ids"] for r in dc.contamination(docs, bench, block_bytes=block).collect()}
        assert got == {1: [1, None], 2: [None], 3: [1], 4: []}
        assert [r["doc_id"] for r in dc.keep_clean(docs, bench, block_bytes=block).collect()] == [4]
