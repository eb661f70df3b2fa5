import re
from collections import Counter
from fractions import Fraction
from math import comb

import duckdb
import pytest

from leafmill.llm import quality, queries

from .helpers import AWKWARD_SCHEMA, awkward


def features(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def oracle(sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return sorted(con.execute(queries.oracle_sql()["op1_quality_rules"]).fetchall())


def test_query_and_oracle(spark, sf):
    got = sorted(map(tuple, queries.op1_quality_rules(spark, sf).collect()))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert [g[:7] for g in got] == sorted((i, *features(t)) for i, t in docs.items())
    assert got == oracle(sf)


def test_certified_cutoffs_and_oracle(spark, tmp_path):
    rows, labels = [], []
    for i in range(7000):
        bad = i % 7 == 0
        noise = "# * $ | " * (i % 5 + 5) if bad else "& " * (i % 3 == 0)
        rows.append((i, " ".join(f"word{i}x{k}" for k in range(20)) + " " + noise, "en" if i % 2 else None))
        labels += [(i, 0 if bad else 1, 0)] * (1 + i % 2)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (10**9, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(map(tuple, queries.op1_quality_rules(spark, str(tmp_path)).collect()))
    kept = {g[0] for g in got if g[-1]}
    assert kept == {i for i in range(7000) if i % 7}  # every bad one goes, every good one stays
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(quality.ORACLE).fetchall())


@pytest.mark.parametrize("n,p", [(1, 0.005), (40, 0.1), (1000, 0.005), (2000, 0.005)])
def test_binomial_tail_is_exact(spark, n, p):
    from pyspark.sql import functions as F

    ks = [k for k in range(min(n, 80)) if k < n * p]
    got = spark.createDataFrame([(k,) for k in ks], "k int").select(quality.binomial_tail(F.col("k"), F.lit(n), p)).collect()
    q = Fraction(p)
    for k, (x,) in zip(ks, got):
        want = float(sum(comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k + 1)))
        assert abs(x - want) <= 1e-9 * want


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), AWKWARD_SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = [tuple(r) for r in quality.report(df, lab).collect()]
        assert sorted(map(str, (g[:7] for g in got))) == sorted(str((r[0], *features(r[1]))) for r in awkward())
        assert all(g[7] == (not g[6]) for g in got)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(not features(r[1])[5] for r in awkward())
    assert quality.report(df.limit(0), labels).collect() == []
