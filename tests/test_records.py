import pytest

from leafmill.operators import records as R


def test_lookup_raises_for_a_missing_key(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    assert R.lookup(rows, "k", 1).collect() == [(1, "a")]
    with pytest.raises(LookupError):
        R.lookup(rows, "k", 2)


def test_pieces_keep_marks_with_their_word(spark):
    rows = spark.createDataFrame([("«abc», d-e",), ("كِتَاب؟",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(R.split_pieces(rows.t)).collect()]
    assert got == [[["«", "abc", "»,"], ["d", "-", "e"]], [["كِتَاب", "؟"]], [], None]


def test_the_nth_note_meets_the_nth_call(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, id long")
    got = R.match_by_rank(rows(("a", 1), ("a", 2), ("b", 3)), rows(("a", 7), ("b", 9), ("b", 8)), ["k"], "id")
    assert sorted(got.select("left_id", "right_id").collect()) == [(1, 7), (2, None), (3, 8)]
