"""Footnote calls, notes and links against plain loops, and the repair rules on pages made for them."""

import random
import re

from leafmill.operators import footnotes as N
from leafmill.plans import books

CALLS = "page long, block long, call int, start int, end int, key string, marker string, style string, rank int, leading boolean"


def test_styles_of_calls():
    found = lambda text: [(c["key"], c["style"], c["rank"]) for c in N.calls_in(text)]
    assert found("word (1) and [2] and (*)") == [("1", "bracket", 0), ("2", "bracket", 0), ("*", "bracket", 0)]
    assert found("الفيل٢ then word³") == [("2", "glued", 0), ("3", "superscript", 0)]
    assert found("الفيل ٢ مرحلة") == [("2", "standalone", 2)] and found("الفيل ٢ .") == [("2", "standalone", 1)]
    assert found("دينار » ١ ،") == [("1", "quoted", 0)]
    assert found("word (ا) and (”) or ( ) here") == [("", "lookalike", 2)] * 3
    assert found('المخالفة"٢"،') == [("2", "quoted", 0)] and found("صدقة ” “ .") == [("", "lookalike", 1)]
    assert found("سنة 21 للهجرة") == [] and found("in 3 ـ book") == [] and found("year 21 ه") == []
    assert found("») ا .") == [("1", "alef", 1)] or found("» ا .") == [("1", "alef", 1)]
    assert N.calls_in("(1) opens")[0]["leading"] and not N.calls_in("x (1)")[0]["leading"]
    assert N.calls_in("") == []


def plain_links(notes, calls):
    """Links of one page by the rules, note by note."""
    used, at, how = set(), {}, {}
    for n, key in notes:
        for rank in (0, 1, 2):
            c = next((c for c, x in enumerate(calls) if key is not None and c not in used and x["key"] == key and x["rank"] == rank), None)
            if c is not None and n not in at:
                used.add(c)
                at[n], how[n] = c, "number"
    keys = [k for _, k in notes if k is not None]
    left = [x for x in notes if x[0] not in at]
    for n, key in left:
        if key and key.isdigit() and 1 <= int(key) <= 9 and key + "1" not in keys:
            for c, x in enumerate(calls):
                if c not in used and x["style"] == "bracket" and x["key"] == key + "1" and not x["leading"]:
                    used.add(c)
                    at[n], how[n] = c, "hung"
                    break
    numbers = [int(k) for k in keys if k.isdigit()]

    def by_place(x):
        if x["style"] not in ("bracket", "superscript") or x["leading"]:
            return False
        return x["key"].startswith("*") or x["key"].isdigit() and 1 <= int(x["key"]) <= 15 and (not numbers or int(x["key"]) < min(numbers))

    places = [c for c, x in enumerate(calls) if c not in used and by_place(x)]
    for n, key in left:
        if key is None and places:
            c = places.pop(0)
            used.add(c)
            at[n], how[n] = c, "place"
    for rule in ("lookalike", "misread"):
        wanting = [n for n, k in left if n not in at and (k is None or k.isdigit() and 1 <= int(k) <= 15)]
        linked = {k for n, k in notes if n in at and k}
        missing = {k for n, k in notes if k} - linked
        if rule == "lookalike":
            picks = [c for c, x in enumerate(calls) if c not in used and x["style"] == "lookalike" and not x["leading"]]
        else:
            picks = [c for c, x in enumerate(calls) if c not in used and not x["leading"] and x["style"] in ("bracket", "superscript") and x["key"].isdigit() and 1 <= int(x["key"]) <= 15 and x["key"] not in missing]
        fits = bool(wanting) and len(wanting) == len(picks)
        for n, c in zip(wanting, picks):
            for m, d in at.items():
                fits = fits and not (m < n and d > c) and not (m > n and d < c)
        if fits:
            for n, c in zip(wanting, picks):
                used.add(c)
                at[n], how[n] = c, rule
    return [(n, at.get(n), how.get(n)) for n, _ in notes]


def test_links_equal_the_loop(spark):
    rng, notes, calls, want = random.Random(1), [], [], []
    for page in range(400):
        own = [(n, rng.choice([None, "1", "2", "3", "4", "11", "*", "20"]) if rng.random() < 0.5 else str(n + 1)) for n in range(rng.randrange(5))]
        listed = []
        for c in range(rng.randrange(6)):
            style = rng.choice(["bracket", "bracket", "bracket", "superscript", "glued", "standalone", "lookalike", "alef"])
            key = "" if style == "lookalike" else rng.choice(["1", "2", "3", "4", "5", "11", "21", "*", "40"])
            listed.append({"key": key, "style": style, "rank": 0 if style in N.STRONG else rng.choice([1, 2]), "leading": rng.random() < 0.1})
        notes += [(page, n, k, None) for n, k in own]
        calls += [(page, 0, c, c, c + 1, x["key"], x["key"], x["style"], x["rank"], x["leading"]) for c, x in enumerate(listed)]
        want += [(page, *x) for x in plain_links(own, listed)]
    df = spark.createDataFrame(notes, "page long, note int, key string, from_page long")
    got = N.link(df, spark.createDataFrame(calls, CALLS))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {w[3] for w in want} == {None, "number", "hung", "place", "lookalike", "misread"}
    codes = {r["code"] for r in N.warnings(got, spark.createDataFrame(calls, CALLS)).collect()}
    assert codes == {"note_orphan", "note_marker_missing", "note_call_repaired", "marker_unmatched"}
    assert N.link(df.limit(0), spark.createDataFrame(calls, CALLS)).count() == 0
    assert {r["how"] for r in N.link(df, spark.createDataFrame([], CALLS)).collect()} == {None}


def parsed(spark, pages, calls=()):
    rows = [("b", number, number * 10, k, t) for number, lines in pages for k, t in enumerate(lines)]
    lines = spark.createDataFrame(rows, "book string, number long, page long, line int, text string")
    got = N.parse_notes(lines, spark.createDataFrame(list(calls), CALLS)).collect()
    return sorted((r["page"] // 10, r["note"], r["key"], r["text"], r["from_page"]) for r in got)


def test_notes_of_pages(spark):
    assert parsed(spark, [(1, ["(1) first", "goes on", "(2) second"])]) == [(1, 0, "1", "first goes on", None), (1, 1, "2", "second", None)]
    # A bare number counts in sequence only, where others are bracketed; a big one never out of it.
    assert parsed(spark, [(1, ["(1) first", "121 - a saying", "(2) second"])]) == [(1, 0, "1", "first 121 - a saying", None), (1, 1, "2", "second", None)]
    assert parsed(spark, [(1, ["(1) first", "(18) a reference"])]) == [(1, 0, "1", "first (18) a reference", None)]
    assert parsed(spark, [(1, ["1 - first", "19 - a saying", "٢ ـ second"])]) == [(1, 0, "1", "first 19 - a saying", None), (1, 1, "2", "second", None)]
    assert parsed(spark, [(1, ["* starred", "5 ه year"])]) == [(1, 0, "*", "starred 5 ه year", None)]
    assert parsed(spark, [(1, ["", " "])]) == []


def test_notes_carried_over(spark):
    last = (1, ["(1) that does not end"])
    assert parsed(spark, [last, (2, ["rest of it", "(1) new"])])[1:] == [(2, 0, None, "rest of it", 10), (2, 1, "1", "new", None)]
    assert parsed(spark, [(1, ["(1) that ends."]), (2, ["= rest of it", "(3) new"])])[1] == (2, 0, None, "rest of it", 10)
    assert parsed(spark, [(1, ["(1) that ends."]), (2, ["a new one", "(3) new"])])[1] == (2, 0, None, "a new one", None)
    assert parsed(spark, [(1, ["(1) that ends."]), (2, ["more", "(1) new"])])[1] == (2, 0, None, "more", 10)
    assert parsed(spark, [last, (3, ["no page between"])])[1] == (3, 0, None, "no page between", None)
    open_call = (20, 0, 0, 5, 8, "2", "2", "bracket", 0, False)
    assert parsed(spark, [last, (2, ["a note of this page", "(5) other"])], [open_call])[1] == (2, 0, None, "a note of this page", None)
    assert parsed(spark, [last, (2, ["a note of this page", "(5) other"])])[1] == (2, 0, None, "a note of this page", 10)


def test_orphans_go_to_the_nearest_block(spark):
    blocks = spark.createDataFrame([("b", 2, 20, 4), ("b", 2, 20, 5), ("b", 5, 50, 9)], "book string, number long, page long, block long")
    orphans = spark.createDataFrame([("b", 1, 10, 0), ("b", 2, 20, 0), ("b", 2, 20, 1), ("b", 3, 30, 0), ("c", 1, 70, 0)], "book string, number long, page long, note int")
    got = sorted(map(tuple, N.hosts(orphans, blocks).collect()))
    assert got == [(10, 0, 4, 0), (20, 0, 5, 0), (20, 1, 5, 1), (30, 0, 5, 2), (70, 0, None, None)]


def test_stray_notes(spark):
    blocks = spark.createDataFrame([(1, 0, "text with a call (2) in it"), (1, 1, "(2) a note left here"), (2, 0, "(1) list"), (2, 1, "(2) list"), (3, 0, "call (1) here"), (3, 1, "(1) in between"), (3, 2, "more text")], "page long, block long, text string")
    calls = N.find_calls(blocks)
    links = spark.createDataFrame([], "page long, note int, call int, how string")
    assert sorted(map(tuple, N.strays(blocks, calls, links).collect())) == [(1, 1, "2", True), (3, 1, "1", False)]


def test_queries_link_most_notes(spark, sf):
    how = {r["how"]: r["count"] for r in books.footnote_links(spark, sf).groupBy("how").count().collect()}
    assert how["number"] > sum(v for k, v in how.items() if k != "number") and {"hung", "place", None} <= set(how)
    _, calls, notes, _ = books._linked(spark, sf)
    by: dict = {}
    for r in calls.orderBy("page", "call").collect():
        by.setdefault(r["page"], []).append(r.asDict())
    own: dict = {}
    for r in notes.where("from_page IS NULL").orderBy("page", "note").collect():
        own.setdefault(r["page"], []).append((r["note"], r["key"]))
    want = sorted(((page, *x) for page, n in own.items() for x in plain_links(n, by.get(page, []))), key=repr)
    got = sorted(((r["page"], r["note"], r["call"], r["how"]) for r in books.footnote_links(spark, sf).collect()), key=repr)
    assert got == want


def test_styles_without_their_characters_are_passed_over(monkeypatch):
    """A text is gone through by the styles whose characters it has alone; what is found is the same."""
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "كلمة ", "(1)", "[٣] ", "”", "ا ", "¹", "7", " 12 .", "*", "(", ")", "« ", "text. "]) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    short, tried = [N.calls_in(t) for t in texts], []

    class Seen:
        def __init__(self, pattern):
            self.finditer = lambda text: tried.append(text) or pattern.finditer(text)

    monkeypatch.setattr(N, "STYLES", [(style, Seen(p)) for style, p in N.STYLES])
    assert N.calls_in("plain words of a text") == [] and not tried
    monkeypatch.setattr(N, "NEEDED", [re.compile("")] * len(N.NEEDED))
    assert short == [N.calls_in(t) for t in texts]


def test_hosts_do_not_make_the_blocks_texts_again(spark, sf):
    from leafmill.plans import books

    blocks, _ = books._noted(spark, sf)
    assert "array_join" not in blocks.select("book", "number", "page", "block")._jdf.queryExecution().optimizedPlan().toString()
    assert all(hasattr(t, "written_at") for t in books._book(spark, sf))
