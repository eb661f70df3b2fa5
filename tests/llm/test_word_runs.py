"""Runs of words against a definition-by-definition search on small texts, and the query against it on whole tables."""

import hashlib
import random
import zlib

import pytest

from leafmill.llm import word_runs
from leafmill.llm.queries import op12_word_runs

from .helpers import AWKWARD_SCHEMA, awkward


def brute(words, most=None):
    """Every maximal stretch of each period, kept if no smaller period has the same stretch."""
    n, out = len(words), {}
    for q in range(1, (most or n // 4) + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i - q, j - i + q), q)
            i = j
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def changed(doc, words):
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row(doc, text):
    words = changed(doc, (text or "").encode().split())
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)), len(words))


@pytest.mark.parametrize("seed", range(40))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = []
        while len(words) < rng.choice([3, 10, 30, 90, 250]):
            if rng.random() < 0.6:
                unit = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(1, 14))]
                words += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
            else:
                words += [rng.randrange(6) for _ in range(rng.randrange(8))]
        assert word_runs.runs_of(words) == brute(words), words


def test_grammar_derives_the_text_and_repeats_no_pair():
    for seed in range(50):
        rng = random.Random(seed)
        words = [rng.randrange(4) for _ in range(rng.randrange(1, 200))]
        rules, top, terminals = word_runs.re_pair(words)
        derive = lambda s: [s] if s < terminals else derive(rules[s - terminals][0]) + derive(rules[s - terminals][1])
        assert [w for s in top for w in derive(s)] == words
        seen = [p for p in zip(top, top[1:]) if p[0] != p[1]]
        assert len(seen) == len(set(seen))


def test_long_texts_of_one_word_and_of_long_periods():
    assert word_runs.runs_of(["a"] * 100_000) == [(0, 100_000, 1)]
    unit = list(range(4000))
    assert word_runs.runs_of([-1, *unit * 5, -2]) == [(1, 20_000, 4000)]
    assert word_runs.runs_of(unit * 3) == []


def test_awkward_rows(spark):
    rows = awkward() + [(100 + k, " ".join(["go on and"] * k), None, None, None, None, None, None, None) for k in range(8)]
    docs = spark.createDataFrame(rows, AWKWARD_SCHEMA).withColumnRenamed("n", "runs").withColumnRenamed("fp", "collapsed")
    got = word_runs.digest(word_runs.find_runs(word_runs.with_known_runs(docs)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((row(r[0], r[1]) for r in rows), key=repr)
    assert word_runs.digest(word_runs.find_runs(docs.limit(0))).count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op12_word_runs(spark, sf).collect()))
    assert got == sorted(row(r["doc_id"], r["text"]) for r in docs)
    assert any(r[1] for r in got)
