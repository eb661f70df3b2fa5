"""Subword lattice likelihood of whole documents.

A public vocabulary's pieces, with the scores it brings as a prior, form a unigram model of pieces.  A word's
probability is the sum over all its segmentations, by a forward recursion in log space over its lattice; a document's
is the product over its words and its end.  The piece probabilities are learned from the training documents: some
rounds of expectation-maximisation over their distinct words, each weighted by its count, in the same lattice.
Words are handled in blocks of equal length, so numpy runs the recursion for thousands at a time.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_words_of, materialize, slices

#: Multiplier of the rolling hash of a piece's bytes, modulo 2**64.
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Weight of the vocabulary's own scores, in pieces.
PRIOR = 1000.0
#: Cells of a block: words times places.
BLOCK = 1 << 18
#: Words whose counts every task holds, at most; the other words' counts are joined.
HEAD = 300_000


@dataclass
class Pieces:
    """Unigram pieces as bytes (the space mark is a space) with natural-log probabilities; the last one is the end."""

    texts: list[bytes]
    logp: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self):
        by: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.texts):
            h = 0
            for b in t:
                h = (h * int(PRIME) + b + 1) % 2**64
            by.setdefault(len(t), []).append((h, k))
        for n, pairs in sorted(by.items()):
            pairs.sort()
            self.tables[n] = (np.array([h for h, _ in pairs], dtype=np.uint64), np.array([k for _, k in pairs]))
        self.some = np.zeros(1 << 20, dtype=bool)
        for hashes, _ in self.tables.values():
            self.some[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def edges(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For words (a row each, of equal length): by piece length, the piece that begins at each place, or -1."""
        rows, n = words.shape
        out, h = {}, np.zeros((rows, n), dtype=np.uint64)
        codes = words.astype(np.uint64) + np.uint64(1)
        for m in range(1, min(n, max(self.tables)) + 1):
            h = h[:, : n - m + 1] * PRIME + codes[:, m - 1 :]
            if m not in self.tables:
                continue
            hashes, which = self.tables[m]
            flat = h.ravel()
            maybe = np.flatnonzero(self.some[(flat >> np.uint64(44)).astype(np.int64)])
            at = np.searchsorted(hashes, flat[maybe])
            at[at == len(hashes)] = 0
            hit = hashes[at] == flat[maybe]
            if hit.any():
                piece = np.full(flat.shape, -1, dtype=np.int32)
                piece[maybe[hit]] = which[at[hit]]
                out[m] = piece.reshape(h.shape)
        return out

    def forward(self, words: np.ndarray, edges: dict[int, np.ndarray] | None = None, kind: type = np.float64) -> np.ndarray:
        """Log of the sum over segmentations of each word's first 0..n bytes, (n + 1) columns."""
        edges = self.edges(words) if edges is None else edges
        logp = np.append(self.logp, -np.inf).astype(kind)
        cost = {m: logp[e] for m, e in edges.items()}
        n = words.shape[1]
        alpha = np.full((words.shape[0], n + 1), -np.inf, dtype=kind)
        alpha[:, 0] = 0
        for i in range(1, n + 1):
            terms = [alpha[:, i - m] + c[:, i - m] for m, c in cost.items() if m <= i]
            if terms:
                alpha[:, i] = _logsum(terms)
        return alpha

    def backward(self, n: int, edges: dict[int, np.ndarray], rows: int, kind: type = np.float64) -> np.ndarray:
        logp = np.append(self.logp, -np.inf).astype(kind)
        cost = {m: logp[e] for m, e in edges.items()}
        beta = np.full((rows, n + 1), -np.inf, dtype=kind)
        beta[:, n] = 0
        for i in range(n - 1, -1, -1):
            terms = [beta[:, i + m] + c[:, i] for m, c in cost.items() if m <= n - i]
            if terms:
                beta[:, i] = _logsum(terms)
        return beta

    def expect(self, words: list[bytes], counts: list[int]) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, times their counts.

        The recursions run in single precision (a use is right to some 1e-5 of itself); uses are summed in double.
        """
        logp = self.logp.astype(np.float32)
        total = np.zeros(len(self.texts))
        for own, block in blocks(words):
            edges, n = self.edges(block), block.shape[1]
            alpha, beta = self.forward(block, edges, np.float32), self.backward(n, edges, len(own), np.float32)
            weight = np.asarray(counts, dtype=float)[own]
            for m, e in edges.items():
                r, c = np.nonzero(e >= 0)
                p = e[r, c]
                use = np.exp(alpha[r, c] + logp[p] + beta[r, c + m] - alpha[r, n]) * weight[r]
                total += np.bincount(p, use, len(total))
        return total

    def log10(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for own, block in blocks(words):
            out[own] = self.forward(block)[:, -1] / np.log(10)
        return out


def _logsum(terms: list[np.ndarray]) -> np.ndarray:
    top = terms[0] if len(terms) == 1 else np.maximum.reduce(terms)
    if len(terms) == 1:
        return top
    safe = np.where(np.isneginf(top), top.dtype.type(0), top)
    with np.errstate(divide="ignore"):
        return safe + np.log(sum(np.exp(t - safe) for t in terms))


def blocks(words: list[bytes]):
    """``(indices, array)`` of words of equal length, each with a space before it."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for n, own in by.items():
        step = max(1, BLOCK // (n + 1))
        for a in range(0, len(own), step):
            some = own[a : a + step]
            flat = np.frombuffer(b"".join(b" " + words[k] for k in some), dtype=np.uint8)
            yield np.array(some), flat.reshape(len(some), n + 1)


def vocabulary(path: str) -> Pieces:
    """Pieces of a sentencepiece model and a first distribution by its scores (ranks, as merge order gives them).

    All 256 byte pieces are among them or added, so every word has a segmentation; pieces of equal bytes are one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        if b" " not in raw[1:]:
            weight[raw] = weight.get(raw, 0) + 1 / (10 + abs(model.get_score(i)))
    least = min(weight.values())
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    p = np.array(list(weight.values()))
    return Pieces([*weight, b""], np.log(np.append(p / p.sum() * 0.999, 0.001)))


def held_out(id_col: Column) -> Column:
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7) == 2


def count_words(docs: DataFrame) -> DataFrame:
    """``(word binary, c)`` over ``docs(doc_id, text)``; the end is the empty word.  Counted in each task first."""

    def run(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for batch in slices(batches, weigh="text"):
            for x in batch.column(1).to_pylist():
                seen.update(lower_words_of(x))
                seen[b""] += 1
            if len(seen) > 400_000:
                yield rows()
        yield rows()

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, start: Pieces, rounds: int = 4) -> Pieces:
    """Expectation-maximisation over all distinct words; each task sums its own words, the driver gets one sum a piece."""
    spark, pieces = counts.sparkSession, start
    prior = np.exp(start.logp) * PRIOR
    ends = counts.where(F.col("word") == F.lit(b"")).agg(F.sum("c")).first()[0] or 0
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((pieces.texts, pieces.logp))

        def run(batches, now=now):
            model, total = Pieces(*now.value), 0.0
            for batch in slices(batches, rows=20_000):
                total = total + model.expect(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if isinstance(total, np.ndarray):
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "uses"])

        uses = prior.copy()
        for r in counts.where(F.col("word") != F.lit(b"")).mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas().itertuples():  # a row a piece
            uses[r.piece] += r.uses
        uses[-1] += ends
        pieces = Pieces(pieces.texts, np.log(uses / uses.sum()))
    return pieces


#: The model in use, by its own id: one a worker.
_MODELS: dict[str, tuple] = {}


def score(docs: DataFrame, model: str, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Null and empty texts are the end alone; a null doc_id hashes as the empty string; repeated rows are each scored
    (and each counted in training).  An empty table gives an empty result.  Only id and text are read.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = materialize(count_words(rows.where(~held_out(F.col("doc_id")))), "lm-counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    pieces = fit(counts, vocabulary(model), rounds)
    # The least count such that at most `head` words have it or more: counts of counts by powers of two are few.
    steps = counts.groupBy(F.floor(F.log2("c")).alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect()
    least, held = None, 0
    for r in steps:
        held += r["n"]
        if held > head:
            break
        least = 2 ** r["b"]
    top = {bytes(r["word"]): r["c"] for r in counts.where((F.col("c") >= least) & (F.col("word") != F.lit(b""))).collect()} if least else {}
    shared = spark.sparkContext.broadcast((pieces.texts, pieces.logp, top))
    ident = uuid.uuid4().hex

    def run(batches):
        from pyspark import TaskContext

        if ident not in _MODELS:
            _MODELS.clear()
            texts, logp, known = shared.value
            _MODELS[ident] = (Pieces(texts, logp), {}, {w: np.log10(c + 1) for w, c in known.items()})
        lattice, cache, known = _MODELS[ident]
        end = float(lattice.logp[-1] / np.log(10))
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, weigh="text"):
            if len(cache) > 900_000:
                cache.clear()
            texts = [lower_words_of(x) for x in batch.column(1).to_pylist()]
            sets = [set(x) for x in texts]
            new = list(set().union(*sets).difference(cache))
            cache.update(zip(new, lattice.log10(new).tolist()))
            out: list[list] = [[] for _ in range(6)]
            for words, kinds in zip(texts, sets):
                rare = kinds.difference(known)
                seen = Counter(filter(rare.__contains__, words)) if rare else {}
                base = sum(map(known.get, words, repeat(0.0)))
                for c, v in zip(out, (len(words) + 1, len(words) - sum(seen.values()), base, sum(map(cache.__getitem__, words)) + end, list(seen.items()), row)):
                    c.append(v)
                row += 1
            for w in new:
                if len(w) > 64:
                    del cache[w]
            flat = [pair for own in out[4] for pair in own]
            starts = np.concatenate([[0], np.cumsum([len(own) for own in out[4]])]).astype(np.int32)
            columns = [pa.array([w for w, _ in flat], pa.binary()), pa.array([k for _, k in flat], pa.int32())]
            pairs = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(columns, ["word", "k"]))
            yield pa.RecordBatch.from_arrays([pa.array(out[5], pa.int64()), batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()), pairs], ["row", "doc_id", "n_tokens", "n_head", "head_sum", "score", "rare"])

    scored = materialize(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_head long, head_sum double, score double, rare array<struct<word:binary,k:int>>"), "lm-scored")
    rest = counts.where(F.col("c") < least) if least else counts
    rest = rest.where(F.col("word") != F.lit(b""))
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k")
    found = rare.join(rest, "word").groupBy("row").agg(F.sum("k").alias("n_rest"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("rest_sum"))
    ends = counts.where(F.col("word") == F.lit(b"")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()["c"]
    floor = F.log10(F.lit(float(tokens + kinds + 1)))
    return scored.join(found, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rest", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) + F.log10(F.lit(float(ends + 1))) - F.col("n_tokens") * floor).alias("base_score"),
        "score",
    )
