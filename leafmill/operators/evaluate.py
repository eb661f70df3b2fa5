"""Measuring the quotation checker: seeded labelled cases, verdicts and rates a class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import phrase_hits
from .verify import verify

#: Classes and the verdict that each should get.
CLASSES = {"exact": "exact", "replaced": "differs", "dropped": "differs", "swapped": "differs", "absent": "not_found"}


def cases(index: DataFrame, page: str, seed: int, length: int = 10) -> DataFrame:
    """One quotation of ``length`` words a page: ``query, cls, source, words``, drawn and altered by seeded hashes."""
    long = index.where(F.size("norms") >= length + 1)
    draw = lambda k, n: F.pmod(F.xxhash64(F.col(page), F.lit(seed), F.lit(k)), n.cast("long")).cast("int")
    names = F.array(*[F.lit(c) for c in CLASSES])
    base = long.select(F.col(page).alias("query"), F.get(names, draw(1, F.lit(len(CLASSES)))).alias("cls"), F.slice("norms", draw(2, F.size("norms") - length + 1) + 1, length).alias("w"), (draw(3, F.lit(length - 3)) + 1).alias("at"))
    part = lambda a, b: F.slice("w", a, b)
    at = F.col("at")
    altered = (
        F.when(F.col("cls") == "replaced", F.concat(part(F.lit(1), at), F.array(F.concat(F.reverse(F.get("w", at)), F.lit("q"))), part(at + 2, F.lit(length))))
        .when(F.col("cls") == "dropped", F.concat(part(F.lit(1), at), part(at + 2, F.lit(length))))
        .when(F.col("cls") == "swapped", F.concat(part(F.lit(1), at), F.array(F.get("w", at + 1), F.get("w", at)), part(at + 3, F.lit(length))))
        .when(F.col("cls") == "absent", F.transform("w", lambda x: F.concat(F.lit("q"), F.reverse(x), F.lit("q"))))
        .otherwise(F.col("w"))
    )
    return base.select("query", "cls", F.col("query").alias("source"), altered.alias("words"), (altered == F.col("w")).alias("unchanged"))


def report(index: DataFrame, cases: DataFrame, page: str) -> DataFrame:
    """``cls, n, as_expected, located``: rates of right verdicts and of passages found on their own page."""
    want = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    got = verify(index, cases.select("query", "words"), page).select("query", "status", F.col(page).alias("found"))
    right = F.col("status") == F.when(F.col("unchanged"), "exact").otherwise(want[F.col("cls")])
    both = cases.join(got, "query")
    return both.groupBy("cls").agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 4).alias("as_expected"), F.round(F.avg((F.col("found") == F.col("source")).cast("double")), 4).alias("located"))


#: Classes that need kinds and review states: the status and the attribution that each should get.
REVIEWED = {"exact_body": ("exact", "ok"), "exact_notes": ("exact", "ok"), "misattributed_note": ("exact", "note_not_author"), "misattributed_body": ("exact", "body_not_editor"), "replaced_sure": ("differs", "ok"), "doubtful_reading": ("needs_image_check", "ok"), "lost": ("not_found", None)}


def reviewed_cases(index: DataFrame, page: str, seed: int, length: int = 10) -> DataFrame:
    """One quotation a row of ``index(page, kind, norms, states)``: ``query, cls, words, attributed_to``, drawn by seeded hashes.

    Body rows give the body classes and notes the notes' own; the word replaced is a doubtful reading with none beside it
    (``doubtful_reading``), or a sure one with none beside it.  A row that holds no such word gives the exact class of its kind.
    """
    n = F.size("norms") - length
    draw = lambda k, m: F.pmod(F.xxhash64(F.col(page), F.lit(seed), F.lit(k)), m.cast("long")).cast("int")
    rows = index.where(n > 2).withColumn("from", draw(1, F.greatest(n - 1, F.lit(1))) + 1)
    rows = rows.withColumn("w", F.slice("norms", F.col("from") + 1, length)).withColumn("s", F.slice("states", F.col("from") + 1, length))
    note = F.col("kind") == "notes"
    cls = F.when(note, F.get(F.array(*[F.lit(c) for c in ("exact_notes", "misattributed_note")]), draw(2, F.lit(2)))).otherwise(F.get(F.array(*[F.lit(c) for c in ("exact_body", "misattributed_body", "replaced_sure", "doubtful_reading", "lost")]), draw(2, F.lit(5))))
    doubtful = lambda i: F.get("s", i) == "doubtful"
    inner = F.sequence(F.lit(1), F.lit(length - 2))
    alone = lambda own: F.get(F.filter(inner, lambda i: own(i) & ~doubtful(i - 1) & ~doubtful(i + 1)), F.lit(0))
    at = F.when(cls == "doubtful_reading", alone(doubtful)).when(cls == "replaced_sure", alone(lambda i: ~doubtful(i)))
    rows = rows.withColumn("cls", cls).withColumn("at", at)
    rows = rows.withColumn("cls", F.when(F.col("cls").isin("doubtful_reading", "replaced_sure") & F.col("at").isNull(), "exact_body").otherwise(F.col("cls")))
    words = F.when(F.col("at").isNotNull(), F.transform("w", lambda x, i: F.when(i == F.col("at"), F.concat(x, F.lit("zq"))).otherwise(x))).when(F.col("cls") == "lost", F.transform("w", lambda x: F.concat(F.lit("q"), F.reverse(x), F.lit("q")))).otherwise(F.col("w"))
    by = F.when(F.col("cls").isin("exact_notes", "misattributed_body"), "editor").otherwise("author")
    return rows.select(F.col(page).alias("query"), "cls", words.alias("words"), by.alias("attributed_to"))


def systems(index: DataFrame, cases: DataFrame, page: str) -> DataFrame:
    """``cls, system, n, as_expected``: how often each system gives a class what it should.

    ``verify``: status and attribution; ``normal_search`` and ``raw_search``: a phrase search on normal and on written words, which
    can only say that a quotation is there (exact) or not.  A search has no attribution to give, so it cannot find one wrong.
    """
    want = lambda k: F.create_map(*[x for c, v in REVIEWED.items() for x in (F.lit(c), F.lit(v[k]))])[F.col("cls")]
    verdict = verify(index, cases.select("query", "words", "attributed_to"), page).select("query", F.lit("verify").alias("system"), "status", "attribution")

    def phrases(rows: DataFrame, name: str) -> DataFrame:
        sizes = sorted(r[0] for r in cases.select(F.size("words")).distinct().collect())
        hits = [phrase_hits(rows, cases.where(F.size("words") == k).select("query", "words"), page, k).select("query") for k in sizes]
        found = reduce(DataFrame.union, hits).distinct().withColumn("there", F.lit(True))
        return cases.join(found, "query", "left").select("query", F.lit(name).alias("system"), F.when(F.col("there"), "exact").otherwise("not_found").alias("status"), F.lit("ok").alias("attribution"))

    written = index.withColumn("norms", F.coalesce("raws", "norms"))
    every = reduce(DataFrame.unionByName, [verdict, phrases(index, "normal_search"), phrases(written, "raw_search")])
    right = (F.col("status") == want(0)) & (want(1).isNull() | F.col("attribution").eqNullSafe(want(1)))
    return cases.select("query", "cls").join(every, "query").groupBy("cls", "system").agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 4).alias("as_expected"))
