"""Periodic runs of words, found on a Re-Pair grammar of each document.

A run is a stretch whose words repeat with a period at least four times over, and that no neighbouring word prolongs.
The most frequent pair of neighbours becomes a nonterminal until no pair is left twice.  Each run crosses the boundary
between the two halves of exactly one lowest derivation node, so the stretches that cross a nonterminal's boundary are
computed once, within its own expansion, and moved to every place where it is derived; stretches of one period that
overlap by it are one, and the longest stay.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, slices, unsigned, words_of

#: A run repeats so often, and has so many words at least.
TIMES, LEAST = 4, 6
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def regions(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches that hold all runs: every pair of neighbours in a run occurs three times or more in it.

    The text is cut at rarer pairs, and each part again by its own counts, until nothing falls away.
    """
    if len(ids) < LEAST:
        return []
    at = np.arange(len(ids) - 1)
    code = np.unique(ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1].astype(np.int64)
    part, parts = np.zeros(len(at), dtype=np.int64), 1
    while len(at):
        _, own, n = np.unique(part * (int(code.max()) + 1) + code, return_inverse=True, return_counts=True)
        keep = n[own] >= 3
        if keep.all():
            break
        at, code, part = at[keep], code[keep], part[keep]
        if not len(at):
            break
        part = np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(part) != 0))])
        size = np.bincount(part)
        keep = size[part] >= LEAST - 1
        at, code, part = at[keep], code[keep], part[keep]
    if not len(at):
        return []
    first = np.concatenate([[True], np.diff(part) != 0])
    last = np.concatenate([first[1:], [True]])
    return list(zip(at[first].tolist(), (at[last] + 2).tolist()))


def re_pair(words: list[int]) -> tuple[list[tuple[int, int]], list[int], int]:
    """Rules, start sequence and number of terminals; rule ``k`` is symbol ``terminals + k``.

    Of equally frequent pairs the one met first goes first, which keeps the grammar of a periodic text balanced.
    """
    n, terminals = len(words), max(words, default=-1) + 1
    sym, after, before = list(words), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        places.setdefault((words[i], words[i + 1]), []).append(i)
    count = {p: len(x) for p, x in places.items()}
    heap = [(-c, k, p) for k, (p, c) in enumerate(count.items()) if c > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    serial = len(count)
    while heap:
        c, k, pair = heapq.heappop(heap)
        now = count.get(pair, 0)
        if now < 2:
            continue
        if now != -c:
            heapq.heappush(heap, (-now, k, pair))
            continue
        (a, b), new, fresh = pair, terminals + len(rules), {}
        rules.append(pair)
        for i in places.pop(pair):
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue
            left, right = before[i], after[j]
            sym[i], sym[j], after[i] = new, -1, right
            if right < n:
                before[right] = i
                count[b, sym[right]] = count.get((b, sym[right]), 0) - 1
                fresh.setdefault((new, sym[right]), []).append(i)
            if left >= 0:
                count[sym[left], a] = count.get((sym[left], a), 0) - 1
                fresh.setdefault((sym[left], new), []).append(left)
        count[pair] = 0
        for p, x in fresh.items():
            x = [i for i in x if sym[i] == p[0] and after[i] < n and sym[after[i]] == p[1]]
            if len(x) > 1:
                places[p], count[p] = x, len(x)
                heapq.heappush(heap, (-len(x), serial, p))
                serial += 1
    return rules, [s for s in sym if s >= 0], terminals


class Crossing:
    """Stretches of one text that cross a boundary within given limits."""

    def __init__(self, words: list[int]):
        self.words, self.back, self.n = words, words[::-1], len(words)
        w = np.array(words, dtype=np.int64)
        pairs = np.unique(w[:-1] * (w.max() + 1) + w[1:], return_inverse=True)[1] if len(w) > 1 else w[:0]
        fours = np.unique(pairs[:-2] * (pairs.max() + 1) + pairs[2:], return_inverse=True)[1] if len(pairs) > 2 else w[:0]
        self.order = np.argsort(fours, kind="stable")
        self.rank = np.empty(len(fours), dtype=np.int64)
        self.rank[self.order] = np.arange(len(fours))
        ends = np.flatnonzero(np.append(np.diff(fours[self.order]) != 0, True)) + 1 if len(fours) else w[:0]
        group = np.searchsorted(ends, self.rank, side="right")
        #: Places of the four words that begin at a place lie in ``order[low:high]``, in text order.
        self.high = ends[group] if len(ends) else ends
        self.low = np.concatenate([[0], ends[:-1]])[group] if len(ends) else ends

    @staticmethod
    def equal(x: list[int], i: int, j: int, most: int) -> int:
        """How many words from ``i`` and from ``j`` on are alike, ``most`` at most."""
        n, c = 0, 4
        while n < most:
            c = min(c, most - n)
            if x[i + n : i + n + c] != x[j + n : j + n + c]:
                break
            n, c = n + c, 2 * c
        else:
            return n
        while c > 1:
            half = c // 2
            if x[i + n : i + n + half] == x[j + n : j + n + half]:
                n, c = n + half, c - half
            else:
                c = half
        return n

    def periods(self, start: int, cut: int, end: int) -> list[int]:
        """Periods that a run over ``cut`` can have: twice the period lies on one side of it, so four words recur there."""
        w, most = self.words, (end - start) // TIMES
        out = {q for q in range(1, min(3, most) + 1) if (cut + q < end and w[cut] == w[cut + q]) or (cut - 1 - q >= start and w[cut - 1] == w[cut - 1 - q])}
        if most > 3:
            if cut + 4 <= end:
                r = int(self.rank[cut])
                places = self.order[r + 1 : r + 1 + np.searchsorted(self.order[r + 1 : int(self.high[cut])], min(cut + most, end - 4), side="right")]
                out.update((places - cut).tolist())
            if cut - 4 >= start:
                r, low = int(self.rank[cut - 4]), int(self.low[cut - 4])
                places = self.order[low + np.searchsorted(self.order[low:r], max(cut - 4 - most, start)) : r]
                out.update((cut - 4 - places).tolist())
        return sorted(out)

    def find(self, start: int, cut: int, end: int, found: set[tuple[int, int, int]]) -> None:
        """Adds ``(period, start, end)`` of every stretch within the limits that crosses ``cut`` and is long enough."""
        w, n = self.words, self.n
        for q in self.periods(start, cut, end):
            for j in (cut + q, cut - 1):
                # ``j`` and the place a period before it hold the same word, or the run lies on the other side.
                if j >= end or j - q < start or w[j] != w[j - q] or any(q % p == 0 and s <= j - q and j < e for p, s, e in found):
                    continue
                hi = j + self.equal(w, j, j - q, end - j)
                lo = j - self.equal(self.back, n - j, n - j + q, j - q - start)
                if lo - q < cut < hi and hi - lo + q >= max(LEAST, TIMES * q):
                    found.add((q, lo - q, hi))


def region_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """Runs ``(period, start, end)`` of a text given as small numbers."""
    rules, top, terminals = re_pair(words)
    size = [1] * terminals
    for a, b in rules:
        size.append(size[a] + size[b])
    place = [-1] * len(rules)  # one place where each nonterminal is derived
    offset, cuts = 0, []
    for s in top:
        if s >= terminals:
            place[s - terminals] = offset
        offset += size[s]
        cuts.append(offset)
    for k in range(len(rules) - 1, -1, -1):
        a, b = rules[k]
        if a >= terminals:
            place[a - terminals] = place[k]
        if b >= terminals:
            place[b - terminals] = place[k] + size[a]
    text, own, holds = Crossing(words), {}, [False] * (terminals + len(rules))
    for k, (a, b) in enumerate(rules):
        at, whole = place[k], size[terminals + k]
        if whole >= LEAST:
            found: set = set()
            text.find(at, at + size[a], at + whole, found)
            if found:
                own[k] = [(q, s - at, e - at) for q, s, e in found]
        holds[terminals + k] = k in own or holds[a] or holds[b]
    runs: set = set()
    for cut in cuts[:-1]:
        text.find(0, cut, len(words), runs)
    derived: list[list[int]] = [[] for _ in rules]
    for s, after in zip(top, cuts):
        if holds[s]:
            derived[s - terminals].append(after - size[s])
    for k in range(len(rules) - 1, -1, -1):
        a, b = rules[k]
        for at in derived[k]:
            runs.update((q, s + at, e + at) for q, s, e in own.get(k, ()))
        if holds[a]:
            derived[a - terminals] += derived[k]
        if holds[b]:
            derived[b - terminals] += [at + size[a] for at in derived[k]]
    return maximal(runs)


def maximal(stretches) -> list[tuple[int, int, int]]:
    """Stretches of one period that overlap by the period or more are one."""
    out: list[list[int]] = []
    for q, s, e in sorted(stretches):
        if out and out[-1][0] == q and out[-1][2] - s >= q:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([q, s, e])
    return [tuple(x) for x in out]


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """All runs of a list of words as ``(start, length, period)``, by start, then period."""
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    out = []
    for lo, hi in regions(ids):
        small = np.unique(ids[lo:hi], return_inverse=True)[1].tolist()
        out += [(lo + s, e - s, q) for q, s, e in region_runs(small)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist()) if not d]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row: all runs by start and period, and the text without repeats.

    Null and empty texts have no words, no runs and an empty collapsed text.  Repeated rows, rows that share an id and
    rows without one come out each for itself; an empty table gives an empty result; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, weigh="text", most=8 << 20):
            n, runs, kept = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                own = runs_of(words)
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                kept.append(b" ".join(collapse(words, own)))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_known_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` where every tenth id (by its crc32) repeats a stretch of its own words to the end.

    With ``h`` the id's crc32 and ``g = h div 10``, words from number ``g % n`` on repeat with a period that lies between
    a tenth and a third of what is left.  Rows without an id and texts without words stay as they are.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h = unsigned(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", f"[{SPACE_CLASS}]+"), lambda w: w != "")))
    g, n = F.expr("h div 10"), F.size("w")
    a = (g % n).alias("a")
    chosen = chosen.select("doc_id", "text", "w", F.when(n > 0, F.struct(a, (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))).alias("x"))
    place = lambda i: F.when(i < F.col("x.a"), i).otherwise(F.col("x.a") + (i - F.col("x.a")) % F.col("x.p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    return chosen.select("doc_id", F.when(F.col("x").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Digest columns of what :func:`find_runs` returns; nulls for the longest run where there is none."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"), "n_words",
    )
