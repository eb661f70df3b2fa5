"""Repeats that a reader wrote and the print has not: a unit of words written twice, and the clean start of a loop."""

from __future__ import annotations

import re
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import text as T
from .sequence import cut_repeats

#: Words of a repeated unit; words that a clean start must have; copies that make a loop (of equal text, of digits masked).
LOW, HIGH, LEAST = 6, 40, 3
COPIES, MASKED = 3, 4
CUT = Y.StructType([Y.StructField("start", Y.IntegerType()), Y.StructField("stop", Y.IntegerType()), Y.StructField("words", Y.IntegerType())])
START = Y.StructType([Y.StructField("text", Y.StringType()), Y.StructField("cut", Y.BooleanType())])
_ARABIC = re.compile("[ء-غف-يٱ-ۓ]")


def doubled_unit(words: list[str], allowed=lambda start, length: True, low: int = LOW, high: int = HIGH) -> tuple[int, int, int] | None:
    """``(start, length, gap)`` of the first unit that recurs at once (``gap`` 0) or after one token without a letter (1).

    Of units with one start the longest counts.  For each distance the places where the words are equal form runs; a unit
    stands where such a run is as long as it, so all lengths are looked at in one pass each and no words are compared twice.
    """
    n, number = len(words), {}
    # A unit's first words recur at its distance: most texts have no such words, the others few distances to look at.
    at: dict[tuple, list[int]] = {}
    for i, g in enumerate(zip(*[words[k:] for k in range(low)])):
        at.setdefault(g, []).append(i)
    distances = {j - i for places in at.values() if len(places) > 1 for k, i in enumerate(places) for j in takewhile(lambda j: j - i <= high + 1, places[k + 1 :])}
    if not distances:
        return None
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    hits = []
    for distance in sorted(d for d in distances if low <= d <= min(high + 1, n)):
        same = ids[:-distance] == ids[distance:]
        # Length of the run of equal places from each place on.
        ends = np.where(same, n, np.arange(len(same)))
        run = np.minimum.accumulate(np.append(ends, len(same))[::-1])[::-1][:-1] - np.arange(len(same))
        for gap in (0, 1):
            length = distance - gap
            if low <= length <= high:
                hits += [(int(i), -length, gap) for i in np.flatnonzero(run >= length) if not gap or not _ARABIC.search(words[i + length])]
    for i, length, gap in sorted(hits):
        if allowed(i, -length):
            return i, -length, gap
    return None


def doubled(text: str, reference: str, key) -> tuple[int, int, int] | None:
    """Characters ``start, stop`` of what to cut, with the words of the unit; null where nothing is doubled.

    A unit that ``reference`` holds twice is printed twice.  ``key`` gives the form in which both are compared.
    """
    at = [m.span() for m in re.finditer(r"\S+", text)]
    words, ref = [text[a:b] for a, b in at], key(reference)

    def allowed(start: int, length: int) -> bool:
        unit = key(" ".join(words[start : start + length]))
        return not (unit and ref.count(unit) >= 2)

    found = doubled_unit(words, allowed)
    if found is None:
        return None
    start, length, gap = found
    return at[start + length][0], at[start + 2 * length + gap - 1][1], length


def _key(text: str) -> str:
    """White space and case aside; vowel marks dropped."""
    return " ".join(re.sub("[ؐ-ًؚ-ٰٟۖ-ۭـ]", "", text).lower().split())


@F.pandas_udf(CUT)
def doubled_span(text: pd.Series, reference: pd.Series) -> pd.DataFrame:
    found = [doubled(t or "", r or "", _key) or (None, None, None) for t, r in zip(text, reference)]
    return pd.DataFrame({c: pd.array([f[k] for f in found], dtype="Int32") for k, c in enumerate(("start", "stop", "words"))})


def without_doubled(text: Column, span: Column) -> Column:
    """``text`` less a doubled unit: what is before it without its trailing white space, and what comes after."""
    cut = F.trim(F.concat(F.rtrim(F.substr(text, F.lit(1), span["start"])), F.substr(text, span["stop"] + 1, F.length(text))))
    return F.when(span["start"].isNull(), text).otherwise(cut)


@F.pandas_udf(START)
def before_loop(text: pd.Series, capped: pd.Series) -> pd.DataFrame:
    """The text before the unit that repeats at its end, without any copy of it, and whether there was one."""
    out = []
    for t, cap in zip(text, capped):
        t = t or ""
        left = cut_repeats(t, times=COPIES, keep=0)
        if cap:
            left = cut_repeats(left, times=MASKED, keep=0, masked=True)
        # Nothing was cut: what was written stays, trailing white space as well.
        out.append((left, True) if len(left) < len(t.rstrip()) else (t, False))
    return pd.DataFrame(out, columns=["text", "cut"])


def clean_start(start: Column, capped: Column) -> Column:
    """Plain words of :func:`before_loop`'s result; empty where fewer than three are left.

    A word that the cut, or the writer's limit, went through goes, too.
    """
    plain = T.strip_markup(start["text"])
    broken = (start["text"] != "") & ~start["text"].rlike(r"\s$") & (start["cut"] | F.coalesce(capped, F.lit(False)))
    left = F.rtrim(F.when(broken, F.regexp_replace(plain, r"\S+\s*$", "")).otherwise(plain))
    words = F.size(F.filter(F.split(left, r"\s+"), lambda w: w != ""))
    return F.when(words >= LEAST, left).otherwise("")
