import math
import zlib
from collections import Counter

import numpy as np

from leafmill.llm import language_model as lm
from leafmill.llm import queries

from .helpers import AWKWARD_SCHEMA, awkward


def brute(pieces, word):
    """Sum over segmentations, by recursion over the ends of the last piece."""
    p = {t: math.exp(x) for t, x in zip(pieces.texts[:-1], pieces.logp)}
    raw, total = b" " + word, [1.0]
    for i in range(1, len(raw) + 1):
        total.append(sum(total[j] * p.get(raw[j:i], 0) for j in range(i)))
    return total[-1]


def test_lattice_sums_all_segmentations_and_counts_uses():
    texts = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"ba", b" ab", b"bab", b""]
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(len(texts)))
    pieces = lm.Pieces(texts, np.log(p))
    words = [b"a", b"ab", b"abab", b"bababa", "é".encode(), b"babab"]
    got = pieces.log10(words)
    assert np.allclose(got, [math.log10(brute(pieces, w)) for w in words])
    uses = pieces.expect(words, [1, 2, 3, 4, 5, 6])
    step = 1e-6
    for k in (97, 256, 257, 260):  # uses = derivative of the log likelihood by the log probability
        more = pieces.logp.copy()
        more[k] += step
        gain = (lm.Pieces(texts, more).log10(words) - got) @ np.array([1, 2, 3, 4, 5, 6]) * math.log(10) / step
        assert abs(gain - uses[k]) < 1e-3
    assert np.isfinite(pieces.log10([b"q" * 5000])).all()


def check(df, result):
    rows = df.select("doc_id", "text").collect()
    split = lambda t: (t or "").encode().lower().split()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    for i, t in rows:
        if not out(i):
            c.update(split(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        tokens = [*split(t), None]
        want.append((str(i), out(i), len(tokens), sum(x in c for x in tokens), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens), 3)))
    got = result.collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    return got


def test_query(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(df, queries.op7_lattice_lm(spark, sf))
    first = lm.score(df, queries.vocabulary("piece_bpe_32k.model"), rounds=0).collect()
    learned, prior = (sum(r["score"] for r in x if r["held_out"]) for x in (got, first))
    assert learned > 0.85 * prior  # log10 likelihood of held-out texts after and before learning


def test_awkward_rows_and_joined_counts(spark):
    df = spark.createDataFrame(awkward(), AWKWARD_SCHEMA)
    model = queries.vocabulary("piece_bpe_32k.model")
    a = check(df, lm.score(df, model, rounds=1))
    b = check(df, lm.score(df, model, rounds=1, head=5))
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in a) == sorted((str(r["doc_id"]), round(r["score"], 6)) for r in b)
    assert lm.score(df.limit(0), model, rounds=1).collect() == []


def in_double(pieces, words, counts):
    """Expected uses as :meth:`Pieces.expect` gives them, with the recursions in double precision."""
    total = np.zeros(len(pieces.texts))
    for own, block in lm.blocks(words):
        edges, n = pieces.edges(block), block.shape[1]
        alpha, beta = pieces.forward(block, edges), pieces.backward(n, edges, len(own))
        for m, e in edges.items():
            r, c = np.nonzero(e >= 0)
            use = np.exp(alpha[r, c] + pieces.logp[e[r, c]] + beta[r, c + m] - alpha[r, n]) * np.asarray(counts, dtype=float)[own][r]
            total += np.bincount(e[r, c], use, len(total))
    return total


def test_scores_are_sums_over_segmentations_in_either_precision(spark, sf):
    """The score of whole documents against a recursion over all segmentations, under models fitted in double and in single precision."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.vocabulary("piece_bpe_32k.model")
    rows = df.select("doc_id", "text").collect()
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update((t or "").encode().lower().split())
            c[b""] += 1
    start = lm.vocabulary(model)
    words = [w for w in c if w]
    pieces, prior = start, np.exp(start.logp) * lm.PRIOR
    for _ in range(4):
        uses = prior + in_double(pieces, words, [c[w] for w in words])
        uses[-1] += c[b""]
        pieces = lm.Pieces(pieces.texts, np.log(uses / uses.sum()))
    got = {r["doc_id"]: r["score"] for r in lm.score(df, model).collect()}
    texts = {i: (t or "").encode().lower().split() for i, t in rows}
    short = [i for i, w in texts.items() if len(w) < 400][:60]
    p = {t: math.exp(x) for t, x in zip(pieces.texts[:-1], pieces.logp)}
    longest = max(map(len, p))

    def log10(word):
        raw, total = b" " + word, [1.0]
        for k in range(1, len(raw) + 1):
            total.append(sum(total[j] * p.get(raw[j:k], 0) for j in range(max(0, k - longest), k)))
        return math.log10(total[-1])

    known = {w: log10(w) for w in {w for i in short for w in texts[i] if len(w) <= 60}}
    end, worst, compared = float(pieces.logp[-1]) / math.log(10), 0.0, 0
    for i in short:
        if all(w in known for w in texts[i]):
            want = sum(known[w] for w in texts[i]) + end
            worst, compared = max(worst, abs(got[i] - want) / abs(want)), compared + 1
    assert compared > 30
    assert worst < 1e-4, worst  # the recursions' single precision shows in the fifth digit at most
