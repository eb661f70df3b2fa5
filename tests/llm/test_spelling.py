"""Spelling variants against all pairs compared one by one."""

import random
import re
import zlib
from collections import Counter

from leafmill.llm import spelling
from leafmill.llm.queries import op13_spelling_variants

from .helpers import AWKWARD_SCHEMA, awkward

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c > 1}


def neighbours(n):
    """Near words by the wildcard forms of each word: one place left open, or one place put in."""
    at = {}
    for w in n:
        for k in range(len(w)):
            at.setdefault((w[:k], w[k + 1 :], "sub"), []).append(w)
    out = {w: set() for w in n}
    for (a, b, _), own in at.items():
        for w in own:
            out[w].update(x for x in own if x != w)
            if a + b in n:
                out[w].add(a + b)
                out[a + b].add(w)
    return out


def expected(rows):
    n = counted(rows)
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows)
    assert sorted(map(tuple, op13_spelling_variants(spark, sf).collect())) == want
    assert any(r[1] for r in want)


def planted(seed):
    """Words with variants, in chains of forms and with ties."""
    rng, texts = random.Random(seed), []
    letters = "abcdeéñxÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 11))) for _ in range(12)]
    for word in base:
        for step, times in enumerate((2200, 210, 20, 2)):
            texts += [word] * times
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :] + "ab", word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1 :]])
    rng.shuffle(texts)
    return [(i, " ".join(texts[i * 50 : i * 50 + 50])) for i in range(-(-len(texts) // 50))]


def test_planted_chains_and_ties(spark):
    for seed in (1, 2):
        rows = planted(seed)
        got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
        want = expected(rows)
        assert sorted(map(tuple, got.collect())) == want
        assert any(r[1] and r[2] != r[1] for r in want)


def test_parts_and_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(7, 10))) for _ in range(400))) for i in range(30)]
    monkeypatch.setattr(spelling, "PART", 40)
    monkeypatch.setattr(spelling, "BLOCK", 25)
    assert sorted(map(tuple, spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == expected(rows)


def test_near():
    assert spelling.near("abc", "abd") and spelling.near("abc", "abcd") and spelling.near("bc", "abc") and spelling.near("ac", "abc")
    assert not spelling.near("abc", "abc") and not spelling.near("abc", "acb") and not spelling.near("abc", "abcde") and not spelling.near("abcd", "xabc")


def test_awkward_rows(spark):
    rows = awkward() + [(500, "Ärgerlich ärgerlich Straßenbahn " * 3, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, AWKWARD_SCHEMA).withColumnRenamed("n", "word").withColumnRenamed("fp", "form")
    assert sorted(map(tuple, spelling.variants(docs).collect())) == expected([(r[0], r[1]) for r in rows])
    assert spelling.variants(docs.limit(0)).count() == 0
