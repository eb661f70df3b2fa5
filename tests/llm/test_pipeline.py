import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline
from leafmill.llm import decontaminate as dc

from .test_line_dedup import brute as matching_lines
from .test_near_copies import brute as near_copies_left
from .test_quality import features
from .test_tokens import check_packing


def test_stages_equal_brute_force(spark, sf, tmp_path):
    """At this scale no cutoff can be certified, so the base rules alone reject."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "best_fit_packing":
            check_packing(docs, stage(spark, docs, sf))
            break
        if name == "quality_rules":
            rows = {i: t for i, t in rows.items() if not features(t)[5]}
        elif name == "line_dedup":
            gone = {(i[1], n) for i, n in matching_lines(list(rows.items()))}
            rows = {i: "\n".join(s for n, s in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows.items()}
        elif name == "near_dedup":
            rows = dict(near_copies_left(list(rows.items()))[0])
        else:
            index = dc.Index(items)
            rows = {i: t for i, t in rows.items() if not index.matches(t)}
        out = stage(spark, docs, sf)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()} == {i: (t, len(t)) for i, t in rows.items()}, name


def test_empty_and_null_documents(spark, sf):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, some, sf)
            # The base rules reject texts of under ten words; the other stages keep both, near copies as one.
            assert got.count() == {"quality_rules": 0, "near_dedup": min(1, some.count())}.get(name_of[stage], some.count())


name_of = {stage: name for name, stage in corpus_pipeline.STAGES}


def test_chain_on_awkward_rows(spark, sf, tmp_path):
    """Repeated rows, ties, a very long text and clashing columns go through all stages, each on what the one before kept."""
    prose = [f"word{k} and{k * 7 % 50} then{k * 3 % 40}" for k in range(400)]
    text = lambda a, n: " ".join(prose[a : a + n])
    rows = [(1, text(0, 30)), (1, text(0, 30)), (2, text(0, 30)), (3, text(100, 30)), (3, text(200, 30)), (4, " ".join(f"u{k}" for k in range(60_000))), (5, text(300, 40) + "\n" + text(0, 30)), (None, text(350, 20))]
    columns = "doc_id long, text string, lang string, source string, n_chars long, sid long, n int, rank int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1, 2, 3) for i, t in rows], columns)
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if name == "best_fit_packing":
            check_packing(docs, out)
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        texts = {r["text"] for r in docs.collect()}
        assert rows[5][1] in texts and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    # Line dedup empties the copy under id 2 and the line repeated under id 5; rows equal in id and text are one document.
    assert sizes[0] == len(rows) and sizes[1] == len(rows) and "" in {r["text"] for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert text(300, 40) in {r["text"].strip() for r in docs.collect()}
