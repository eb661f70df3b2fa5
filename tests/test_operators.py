"""Operators on small fixtures with expectations worked out by hand."""

from pyspark.sql import functions as F

from leafmill.operators import graph, index, library, search, verify
from leafmill.sources import bundle
from leafmill.streaming import jobs


def numbered(spark, rows):
    return spark.createDataFrame([("b", n, p) for n, p in rows], "book string, number long, printed long")


def test_printed_pages(spark):
    df = numbered(spark, [(1, 11), (2, 12), (3, None), (4, 41), (5, 15), (6, 16), (7, 17)])
    got = {r["number"]: (r["shown"], r["source"]) for r in library.printed_pages(df).collect()}
    assert got[1] == (11, "page") and got[3] == (13, "inferred") and got[4] == (14, "inferred")
    assert {r["source"] for r in library.printed_pages(numbered(spark, [(1, None), (2, None)])).collect()} == {"none"}


def test_sequence_anomalies(spark):
    find = lambda printed: [(r["number"], r["label"], r["expected"]) for r in library.sequence_anomalies(numbered(spark, list(enumerate(printed, 1)))).orderBy("number").collect()]
    assert find([40, 41, 43, 44, 44, 45]) == [(3, "gap", 41), (5, "duplicate", 44)]
    assert find([40, 41, 47, 43, 44]) == [(3, "uncertain", 42)]
    assert find([10, None, 30]) == []


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_head_clusters_are_transitive(spark):
    heads = spark.createDataFrame([("b", k) for k in ("chapterone", "chapterons", "chapterxns", "other")] + [("c", "chapterone")], "book string, key string")
    got = sorted((r["key"], r["cluster"], r["pages"]) for r in library.head_clusters(heads).collect())
    assert got == [("chapterone", "chapterone", 3), ("chapterons", "chapterone", 3), ("chapterxns", "chapterone", 3)]


def pages(spark):
    rows = [(1, "b", 1, "alpha beta gamma delta epsilon zeta"), (2, "b", 2, "eta theta iota kappa lambda mu"), (3, "b", 5, "gamma beta alpha and more of the alphabet"), (4, "c", 1, "nothing here at all")]
    return index.index_pages(spark.createDataFrame(rows, "page_id long, book string, number long, text string"))


def test_search_modes(spark):
    queries = spark.createDataFrame([(1, ["beta", "gamma", "delta"]), (2, ["gamma", "alpha"]), (3, ["theta", "iotta", "kappa", "lambda"])], "query int, words array<string>")
    got = sorted((r["query"], r["mode"], r["page_id"], r["start"], r["end"]) for r in search.search(pages(spark), queries, "page_id").collect())
    assert (1, 0, 1, 1, 4) in got and (2, 1, 1, 0, 3) in got and (2, 1, 3, 0, 3) in got and (3, 2, 2, 0, 5) in got  # the window begins at the space before "theta"
    cross = spark.createDataFrame([(9, ["zeta", "eta", "theta"])], "query int, words array<string>")
    assert [(r["page_id"], r["cut"]) for r in search.across_pages(pages(spark), cross, "page_id", "book", "number", 3).collect()] == [(1, 1)]


def test_verify(spark):
    queries = spark.createDataFrame([(1, "beta gamma delta epsilon".split()), (2, "beta gamma DELTA epsilon zeta".split()), (3, "quite another thing".split()), (4, ["beta", "gamma"])], "query int, words array<string>")
    got = {r["query"]: r for r in verify.verify(pages(spark), queries, "page_id").collect()}
    assert [got[k]["status"] for k in (1, 2, 3, 4)] == ["exact", "differs", "not_found", "too_short"]
    assert got[1]["page_id"] == 1 and got[2]["changes"][0]["source"] == "delta"


def test_index_of_reviewed_lines(spark):
    tok = "array<struct<t:string,conf:string,res:string,call:boolean>>"
    rows = [(1, "b", 10, 1, "body", "body", False, [("قال", "high", None, None), ("(١)", "high", None, None), ("الشيخ", "low", None, None)]), (1, "b", 11, 2, "footnote", "body", True, [("حاشية", "high", None, None)]), (1, "b", 12, 0, "body", "running_header", False, [("عنوان", "high", None, None)])]
    df = spark.createDataFrame(rows, f"page_id long, book string, line_id long, ord int, role string, region string, reviewed boolean, tokens {tok}")
    got = {r["kind"]: r for r in index.index_lines(df).collect()}
    assert got["body"]["norm"] == "قال الشيخ" and [w["state"] for w in got["body"]["words"]] == ["unreviewed", "doubtful"]
    assert got["notes"]["norm"] == "حاشيه" and got["notes"]["words"][0]["state"] == "reviewed"


def test_bundle_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 3.5)], "id long, s string, v double")
    bundle.write_bundle({"t": df}, f"file://{tmp_path}/b")
    back = bundle.read_bundle(spark, f"file://{tmp_path}/b")["t"]
    assert sorted(back.collect()) == sorted(df.collect())
    ids = spark.createDataFrame([(1, 101)], "old long, new long")
    assert {r["id"] for r in bundle.remap(back, ids, "id").collect()} == {101, None}
    books = spark.createDataFrame([("b", 2, "", "two"), ("b", 1, "one", "draft"), ("b", 3, None, " ")], "book string, n int, f string, p string")
    assert bundle.export_books(books, "book", "n", "f", "p").first()["text"] == "one\n\ntwo"


def test_streams(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    rows = [(1, "b", "alpha beta", 1), (2, "b", "gamma", 1), (3, "c", "delta", 1)]
    schema = "page_id long, book string, text string, version int"
    for more in (rows, [(2, "b", "gamma new", 2), (3, "c", "", 2)]):
        spark.createDataFrame(more, schema).write.mode("append").parquet(src)
        q = jobs.maintain_index(spark.readStream.schema(schema).parquet(src), f"file://{tmp_path}/ix", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["page_id"]: r["norm"] for r in spark.read.parquet(f"file://{tmp_path}/ix").collect()}
    assert got == {1: "alpha beta", 2: "gamma new"}
    events = spark.createDataFrame([(i, f"2024-01-01 00:00:0{i % 5}", "u") for i in range(10)], "id int, ts string, user string").select("id", F.col("ts").cast("timestamp").alias("ts"), "user")
    events.write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/ev")
    for name, df in (("once", jobs.consume_once(stream, ["user"], "ts")), ("rates", jobs.call_rates(stream, "user", "ts", 5))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("once").count() == 1


def test_flag_policy_and_vote(spark):
    from leafmill.operators import review

    rows = [("كتابΑ", None, None, None, False, True, "script"), ("،", None, None, None, False, True, None), ("1966", "1966", None, None, True, True, None), ("1966", "1965", None, None, True, True, "number"), ("١٩", "19", None, None, True, True, "number"), ("آ", None, None, None, False, True, None), ("كتاب", "كتاب", None, None, True, True, None), ("كتاب", "كاتب", None, None, True, True, "disagree"), ("كتاب", None, None, None, True, True, None), ("كتاب", None, "كاتب", 90.0, True, True, "alone"), ("كتاب", None, "كاتب", 90.0, True, False, "single"), ("كتاب", None, "كناب", 90.0, True, False, None), ("كتاب", None, "كاتب", 50.0, True, False, None), ("كتاب", None, None, None, True, None, None)]
    df = spark.createDataFrame(rows, "t string, s string, tess string, conf double, boxed boolean, two boolean, want string")
    for r in df.select("t", "want", review.flag(*[F.col(c) for c in ("t", "s", "tess", "conf", "boxed", "two")]).alias("got")).collect():
        assert r["got"] == r["want"], r
    votes = spark.createDataFrame([("كتاب", "كاتب", "كاتب", "كاتب"), ("كتاب", "كاتب", "كتاب", None), ("19", "18", "18", None)], "t string, a string, s string, want string")
    assert all(r["got"] == r["want"] for r in votes.select("want", review.vote(F.col("t"), F.col("a"), F.col("s"), F.lit(False), F.lit(False)).alias("got")).collect())


def test_fix_and_undo(spark):
    from leafmill.operators import review

    tokens = spark.createDataFrame([(1, 0, "ab", None, True), (1, 1, "cd", "zz", True), (2, 0, "ef", None, False), (2, 1, "gh", None, True)], "line int, i int, t string, orig string, editable boolean")
    picks = spark.createDataFrame([(1, 0, "ab", "AB"), (1, 1, "xx", "CD"), (2, 0, "ef", "EF")], "line int, i int, seen string, new string")
    got = [tuple(r) for r in review.fix(tokens, picks).orderBy("line", "i").collect()]
    assert got == [(1, 0, "AB", "ab", True, "applied"), (1, 1, "cd", "zz", True, "changed"), (2, 0, "ef", None, False, "page"), (2, 1, "gh", None, True, None)]
    rev = spark.createDataFrame([(1, 10, "x", False, 1), (2, 10, "y", False, 2), (3, 11, "x", False, 3), (4, 11, "y", True, 4)], "id int, line int, batch string, undone boolean, created_at int")
    assert sorted(tuple(r) for r in review.undoable(rev, "x").collect()) == [(10, False), (11, True)]


def test_evaluation(spark):
    from leafmill.operators import evaluate

    rows = [(i, "b", i, " ".join(f"word{i}x{k}" for k in range(30))) for i in range(40)]
    ix = index.index_pages(spark.createDataFrame(rows, "page_id long, book string, number long, text string"))
    made = evaluate.cases(ix, "page_id", 7)
    assert sorted(made.collect()) == sorted(evaluate.cases(ix, "page_id", 7).collect())  # seeded
    got = {r["cls"]: r for r in evaluate.report(ix, made, "page_id").collect()}
    assert set(got) == set(evaluate.CLASSES) and all(r["as_expected"] == 1.0 for r in got.values())
    assert all(r["located"] == 1.0 for c, r in got.items() if c != "absent")


def test_fuzzy_scores_every_prefiltered_page(spark):
    """More than 32 pages hold all words; the approximate hits stand on pages that share fewer."""
    import random

    from leafmill.functions import sequence

    rng = random.Random(4)
    words = ["stone", "river", "of", "the", "lantern", "müde", "st", "a", "mill", "leaves"]
    rows = [(i, "b", i, "the river of stone and " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    rows += [(100 + i, "b", 100 + i, t) for i, t in enumerate(["riverr the stome of lantern", "x riiver ofthe stonee", "river", "of the lanterm rivers of stones", "the rivr of ston", "so a mil", "leave"])]
    ix = index.index_pages(spark.createDataFrame(rows, "page_id long, book string, number long, text string"), arabic=False)
    asked = [(1, "river of the stone".split()), (2, "the lantern of stone river".split()), (3, ["leaves"]), (4, ["a"]), (5, ["a", "mill"]), (6, "river of the stone".split()), (7, ["müde", "st"])]
    queries = spark.createDataFrame(asked, "query int, words array<string>")
    want = set()
    for q, ws in asked:
        longest = sorted(set(ws), key=lambda w: (-len(w), w))[: search.PREFILTER]
        for r in ix.select("page_id", "norm").collect():
            score = sequence.partial_window(" ".join(ws), r["norm"])[0]
            if score >= search.CUTOFF and any(w in r["norm"] for w in longest) and (len(ws) > 1 or len(ws[0]) >= 4):
                want.add((q, r["page_id"], round(score, 6)))
    got = search.fuzzy(ix, queries, "page_id").collect()
    assert len(got) == len(want) > 80 and {tuple(r) for r in got} == want
    hits = search.search(ix, queries, "page_id", limit=50, offset=50).where("query = 1 AND mode = 2").collect()
    assert {r["page_id"] for r in hits} <= {p for q, p, _ in want if q == 1} and any(r["page_id"] >= 100 for r in hits)


def test_passages_over_a_page_break(spark):
    asked = [(1, "epsilon zeta eta theta".split()), (2, "mu gamma beta".split()), (3, "lambda mu nothing".split())]
    queries = spark.createDataFrame(asked, "query int, words array<string>")
    ix = pages(spark)
    got = [tuple(r) for r in search.search(ix, queries, "page_id").where("mode = 0").select("query", "page_id", "start", "end", "rank", "total").collect()]
    assert [g[:5] for g in got] == [(1, 1, 4, 8, 1)]
    checked = {r["query"]: r for r in verify.verify(ix, queries, "page_id").collect()}
    assert (checked[1]["status"], checked[1]["page_id"], checked[1]["start"], checked[1]["end"]) == ("exact", 1, 4, 8)
    assert checked[3]["status"] != "exact"
    near = index.index_pages(spark.createDataFrame([(1, "b", 1, "one two three four"), (2, "b", 3, "five six seven eight")], "page_id long, book string, number long, text string"))
    far = {r["query"]: r for r in verify.verify(near, spark.createDataFrame([(7, "three four five sax".split())], "query int, words array<string>"), "page_id").collect()}
    assert (far[7]["status"], far[7]["page_id"], far[7]["start"], far[7]["end"]) == ("differs", 1, 2, 6)


def test_attribution_doubt_and_running_heads(spark):
    def row(page, book, number, kind, text, doubtful=(), head=(None, 0)):
        words = text.split()
        return (page, book, number, kind, text, words, ["doubtful" if w in doubtful else "reviewed" for w in words], head)

    rows = [
        row(1, "b", 1, "body", "alpha beta gamma delta epsilon zeta", ("gamma",)),
        row(2, "b", 1, "notes", "a note that stands below the text"),
        row(3, "c", 1, "body", "wholly other words of another book", head=("chapter", 1)),
        row(4, "c", 2, "body", "chapter and they go on over the page", head=("chapter", 1)),
    ]
    ix = spark.createDataFrame(rows, "page_id long, book string, number long, kind string, norm string, norms array<string>, states array<string>, head struct<key:string,n:int>")
    asked = [
        (1, "beta gamma delta epsilon".split(), "b", "author"),
        (2, "beta gemma delta epsilon".split(), "b", "author"),
        (3, "note that stands below".split(), None, "author"),
        (4, "beta gamma delta epsilon".split(), "c", "unknown"),
        (5, "alpha beta gamma delta".split(), None, "editor"),
        (6, "of another book and they".split(), "c", "author"),
    ]
    queries = spark.createDataFrame(asked, "query int, words array<string>, in_book string, attributed_to string")
    got = {r["query"]: r for r in verify.verify(ix, queries, "page_id").collect()}
    assert [got[k]["status"] for k in range(1, 7)] == ["exact", "needs_image_check", "exact", "exact", "exact", "exact"]
    assert [got[k]["attribution"] for k in range(1, 7)] == ["ok", "ok", "note_not_author", "other_book", "body_not_editor", "ok"]
    assert got[2]["changes"][0]["source_state"] == "doubtful" and (got[6]["page_id"], got[6]["end_page"]) == (3, 4)
