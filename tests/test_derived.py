"""Words and lines derived once: the short ways give what the full ones give, and no row carries a whole text along."""

import contextlib
import io

from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.plans import books, reviewed

ODD = ["word", "Wort,", "(3)", "3)", "a(1)b", "«mot»", "naïve—été", "x́y", "soft­hyphen", "tab\there", "line\n", "a b", "ابن", "٣٤", "ﷺ", "×÷", "_", "", " two  words ", "ẞß", "don't", "İI", "[12].", "e-mail@x.y", "‏z", None]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(extended=False)
    return out.getvalue()


def test_short_ways_of_words_and_comparison_forms(spark, monkeypatch):
    d = spark.createDataFrame([(t,) for t in ODD], "t string")
    short = d.select(T.words(F.col("t")), T.lenient(F.col("t"))).collect()
    monkeypatch.setattr(T, "_PLAIN", "^(?!)")
    monkeypatch.setattr(T, "_UNFOLDED", "^(?!)")
    assert [tuple(r) for r in short] == [tuple(r) for r in d.select(T.words(F.col("t")), T.lenient(F.col("t"))).collect()]


def test_lines_and_pages_do_not_carry_the_text(spark, tmp_path):
    spark.createDataFrame([(1, "s", "a b"), (2, "s", None), (3, "s", ""), (4, "s", " ".join(map(str, range(401))))], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sheets, lines = books._sheets(spark, str(tmp_path)), reviewed._lines(spark, str(tmp_path))
    assert sorted((r["book"], r["number"], len(r["tokens"])) for r in sheets.collect()) == [(1, 0, 2), (4, 0, 200), (4, 1, 200), (4, 2, 1)]
    assert sorted((r["page_id"], r["ord"], len(r["tokens"])) for r in lines.collect())[-2:] == [(4, 49, 8), (4, 50, 1)]
    for df in (sheets, lines):
        exploded = [x for x in plan(df).splitlines() if "Generate posexplode(" in x]
        assert exploded and all("w#" not in x.split("[")[1].split("]")[0] for x in exploded)


def test_rows_of_reviewed_text_are_written_once(spark, sf):
    assert hasattr(reviewed._rows(spark, sf), "written_at")


def test_uncertain_words_do_not_carry_the_page(spark):
    from leafmill.operators import books as K

    words = [("a", "reviewed"), ("b", "doubtful"), ("c", "reviewed"), ("d", "doubtful")]
    ix = spark.createDataFrame([(1, "body", words)], "page int, kind string, words array<struct<text:string,state:string>>")
    got = K.uncertain_words(ix)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "body", 1, "b", "a", "c d", 1, 2), (1, "body", 3, "d", "a b c", "", 2, 2)]
    assert "Window" not in plan(got)


def test_vocabulary_shuffles_words_not_the_words_of_pages(spark):
    from leafmill.operators import index as I

    index = spark.createDataFrame([(["b", "a", "b"],), (["a"],), ([],), (None,)], "norms array<string>")
    words = I.vocabulary(index)
    assert words._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in words.collect()} == {("a", 2, 2), ("b", 2, 1)}


def test_examples_make_lines_of_a_books_first_pages_alone(spark, tmp_path, monkeypatch):
    from leafmill.operators import index as I
    from leafmill.plans import reviewed

    # Book "late" has no words on its first seventy pages, "short" has few pages, "long" many.
    words = " ".join(f"{w}{'abcdefgh'[k]}" for k in range(8) for w in ("one", "two", "three", "four", "five", "six"))
    books = [("late", None if k < 70 else words) for k in range(120)] + [("short", words)] * 3 + [("long", words)] * 400
    spark.createDataFrame([(i, t, "en", b, 1) for i, (b, t) in enumerate(books)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen, plain = [], I.index_lines
    monkeypatch.setattr(I, "index_lines", lambda lines: seen.append(lines.select("page_id").distinct().count()) or plain(lines))
    got = {r["book"]: r["page"] for r in reviewed.example_quotes(spark, str(tmp_path)).collect()}
    assert set(got) == {"late", "short", "long"} and 70 <= got["late"] < 110 and 123 <= got["long"] < 163
    assert max(seen) < 330


def test_a_long_book_without_headings_is_gone_through_once(spark):
    import time

    from leafmill.operators.sections import section_starts

    n = 200_000
    blocks = spark.range(n).select(F.lit("b").alias("book"), F.col("id").alias("block"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("page"))
    starts, at = {0}, 1
    page = lambda i: i if i % 3 else None
    for i in range(2, n):
        if page(i) is not None and page(i) >= page(at) + 10:
            starts.add(i)
            at = i
    began = time.time()
    assert {r["block"] for r in section_starts(blocks).collect()} == starts
    assert time.time() - began < 90


def test_words_counted_one_by_one_are_not_grouped_by_page(spark, sf):
    from leafmill.plans import reviewed

    words = reviewed._line_words(spark, sf)
    assert "hashpartitioning(page" not in words._jdf.queryExecution().executedPlan().toString()
    own = words.select("page", "kind", F.explode("own.norm").alias("w")).groupBy("page", "kind").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in own.collect()} == {tuple(r) for r in reviewed._index(spark, sf).select("page", "kind", F.size("words").alias("n")).collect()}


def test_pages_are_compared_with_the_next_without_a_row_a_word(spark, tmp_path):
    """Several pages of one number, rows that share an id, and pages without words, as the SQL has them."""
    import duckdb

    from leafmill.plans import texts

    rows = [(0, "a a b c", "s"), (1, "a b b", "s"), (20, "a b b d", "s"), (21, "a a", "s"), (40, "", "s"), (60, "x", "s"), (60, "y x", "s"), (80, "x x y", "s"), (80, "x x y", "t"), (100, None, "s"), (7, "q", None)]
    spark.createDataFrame([(i, t, "en", b, 1) for i, t, b in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.word_f1_pairs(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(texts_sql("word_f1_pairs")).fetchall())
    assert "explode" not in plan(got)


def texts_sql(name):
    from leafmill.plans import registry

    return registry.oracle_sql()[name]


def test_pages_with_words_are_those_of_the_index(spark, sf):
    from leafmill.operators import index as I

    lines = reviewed._lines(spark, sf)
    few = I.pages_with_words(lines)
    assert sorted(r["page_id"] for r in few.collect()) == sorted(r["page_id"] for r in I.index_lines(lines).select("page_id").distinct().collect())
    assert "flatten" not in plan(few)


def test_plain_words_are_flagged_and_read_as_others_are(spark, sf, monkeypatch):
    from leafmill.operators import review as W

    reason = lambda: W.flag(F.col("t"), F.col("second"), F.col("tess"), F.lit(90.0), F.col("boxed"), F.col("two"))
    d = spark.createDataFrame([(a, b, c, x, y) for a in ODD if a is not None for b in ("word", "Word", "x", "(word)", None) for c in ("", "word", "ابن", None) for x in (True, False) for y in (True, False, None)], "t string, second string, tess string, boxed boolean, two boolean")
    short, words = d.select(reason()).collect(), d.select(T.words(F.col("t"))).collect()
    assert "md5(concat_ws(:, cast(page_id" not in plan(reviewed._read(spark, sf))
    monkeypatch.setattr(T, "LETTERS", "^(?!)")
    assert short == d.select(reason()).collect() and words == d.select(T.words(F.col("t"))).collect()
