import random
from collections import defaultdict

from leafmill.llm import line_dedup, queries

from .helpers import AWKWARD_SCHEMA, awkward


def brute(rows):
    """(doc_id, line_no) of lines that match an earlier line: an inverted index gives every overlap, none is skipped."""
    lines = sorted({((i is not None, i or 0), k, frozenset(s.encode().lower().split())) for i, t in rows if t for k, s in enumerate(t.split("\n"))}, key=lambda x: x[:2])
    lines = [x for x in lines if x[2]]
    by_word, sets, gone = defaultdict(list), {}, set()
    for i, k, s in lines:
        if s in sets:
            gone.add((i, k))
            if sets[s] == (i, k):
                gone.discard((i, k))
            continue
        shared = defaultdict(int)
        for w in s:
            for o in by_word[w]:
                shared[o] += 1
        if any(5 * c >= 4 * (len(s) + len(o) - c) for o, c in shared.items()):
            gone.add((i, k))
        sets[s] = (i, k)
        for w in s:
            by_word[w].append(s)
    return gone


def check(df, result):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    gone = defaultdict(list)
    for i, k in sorted(brute(rows)):
        gone[i].append(k)
    want = sorted((str(i), sum(bool(s.encode().split()) for s in (t or "").split("\n")), gone[(i is not None, i or 0)]) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["removed"]) for r in result.collect()) == want
    assert all(r["n_removed"] == len(r["removed"]) for r in result.take(5))
    return sum(map(len, gone.values()))


def test_awkward_rows_and_near_copies(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [rng.sample(vocabulary, rng.choice([4, 5, 9, 12, 30])) for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(4):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
            lines.append(" ".join(words).title() if rng.random() < 0.3 else " ".join(words))
        rows.append((1000 + d, "\n".join(lines) + "\n \n", "en", "s", 1, 1, 1, 1, 1))
    df = spark.createDataFrame(awkward() + rows, AWKWARD_SCHEMA)
    for lead in (2, 1):
        monkeypatch.setattr(line_dedup, "LEAD", lead)
        assert check(df, line_dedup.summary(df)) > 100
    out = line_dedup.dedup(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert line_dedup.summary(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark, sf):
    assert check(spark.read.parquet(f"{sf}/documents.parquet"), queries.op9_line_dedup(spark, sf)) > 100


def test_rows_without_or_with_shared_ids_are_documents_of_their_own(spark, monkeypatch):
    near = ["a b c d e f g h i", "a b c d e f g h j"]
    rows = [(None, f"{near[0]}\nclean one\nthe same line here"), (None, f"{near[1]}\nclean two\nthe same line here"), (None, "wholly different words\nclean three"), (None, "wholly different words\nclean three"), (7, "first text of seven\nkept a"), (7, "other text with seven\nclean one")]
    for lead in (2, 1):
        monkeypatch.setattr(line_dedup, "LEAD", lead)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = [r["text"] for r in line_dedup.dedup(df).collect()]
        lines = [s for t in out for s in t.split("\n")]
        assert sum(s in near for s in lines) == 1 and lines.count("the same line here") == 1 and lines.count("clean one") == 1
        assert {"clean two", "kept a", "first text of seven", "other text with seven"} <= set(lines)
        assert out.count("wholly different words\nclean three") == 2  # one document read twice
        assert sorted(r["n_removed"] for r in line_dedup.summary(df).collect()) == [0, 0, 0, 0, 1, 2]


def test_the_table_of_levels_takes_little_of_the_plan(spark, sf):
    words = line_dedup.tokens(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    plan = line_dedup.signed(words, line_dedup.rarity(words))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 1_000_000  # a megabyte, at two letters a byte, before


def test_a_crowd_of_lines_not_quite_alike_makes_few_candidates(spark, monkeypatch):
    rng = random.Random(8)
    base, made = [f"common{k}" for k in range(60)], []
    rows = [(d, " ".join(f"own{d}x{k}" if k in own else w for k, w in enumerate(base))) for d in range(300) for own in [rng.sample(range(60), 9)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    verified = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *a: made.append(pairs.count()) or verified(pairs, *a))
    check(df, line_dedup.summary(df))
    assert made[-1] < 100


def test_words_that_many_unlike_lines_share_make_no_crowd(spark, monkeypatch):
    """Each of the three rarest words of a line is in 80 lines, any two of them together in few: no line is compared early."""
    rng = random.Random(4)
    rows = [(d, " ".join([f"{pool}{rng.randrange(5)}" for pool in "abc"] + rng.sample([f"common{k}" for k in range(14)], 7))) for d in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    early, write = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda t, tag, **o: (out := write(t, tag, **o), early.append(out.count()) if tag == "line-lead" else None)[0])
    check(df, line_dedup.summary(df))
    assert early == [0]  # 1,200 before
