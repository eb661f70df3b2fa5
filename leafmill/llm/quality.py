"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule scores a document by a share between 0 and 1 and rejects it above a cutoff.  Cutoffs lie on a fixed grid
from lenient to strict.  For each stratum (language) and rule, the labelled documents of good quality are a holdout:
the hypothesis "this cutoff falsely rejects more than ``alpha / rules`` of the good documents" is tested by the exact
binomial tail of the false rejections seen.  The grid is walked from the lenient end and left at the first cutoff
that is not certified (fixed-sequence testing, no correction needed along the walk); over rules and strata the level
is ``delta / (rules * strata)`` (Bonferroni).  So with probability ``1 - delta`` the rules together reject at most
``alpha`` of the good documents in every stratum at once.  Among certified cutoffs the one is taken that rejects the
most bad documents beyond the good ones, the most lenient of equals; without a certified cutoff a rule rejects nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_side
from .common import SPACE_CLASS, materialize

#: Share of good documents that may be rejected, probability that this fails, cutoffs on the grid.
ALPHA, DELTA, GRID = 0.02, 0.05, 50
#: Rules: share of symbols a word, of words in repeated windows, of repeated lines, of capitals among characters.
RULES = ("symbols", "repeats", "lines", "capitals")
#: Words in a window.
WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window found twice or more.  Windows are compared by 64-bit hashes of their five words."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _let(pairs, lambda p: F.filter(F.transform(p, lambda x, k: F.when((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(again), start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")))["n"]

    # Bound to a variable: were this put in the place of a column, a lambda would work out the words anew for each window.
    cut = lambda w: F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    return _let(_let(words, cut), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__q_`` columns: the counts of the words, symbols, lines, repeats and capitals of each text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.withColumns({"__q_words": F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), ""), "__q_text": text})
    lines = F.filter(F.split("__q_text", "\n"), lambda s: s.rlike(f"[^{SPACE_CLASS}]"))
    return cut.withColumns(
        {
            "__q_n_words": F.size("__q_words").cast("long"),
            "__q_word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
            "__q_n_symbols": F.regexp_count("__q_text", F.lit("[#*$%&|<>]")).cast("long"),
            "__q_lines": _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
            "__q_n_repeat_words": repeat_words(F.col("__q_words")).cast("long"),
            "__q_capitals": F.regexp_count("__q_text", F.lit(r"\p{Lu}")).cast("long"),
        }
    ).drop("__q_words", "__q_text")


def _level(part: Column, whole: Column) -> Column:
    """The first grid step whose cutoff the share ``part / whole`` exceeds: cutoff k is ``1 - (k + 1) / (GRID + 1)``.

    GRID if it exceeds none.  In whole numbers, so equal documents get equal levels everywhere.
    """
    steps = F.lit(GRID + 1)
    return F.when(part <= 0, F.lit(GRID)).otherwise(F.greatest(F.lit(0), F.least(F.lit(GRID), F.floor((whole - part) * steps / F.greatest(whole, F.lit(1))).cast("int"))))


def _lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series after moving x up by eight."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - reduce(lambda a, b: a + b, [F.log(x + k) for k in range(8)])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exact up to rounding; 1 where k is not below the mean (nothing is certified).

    The terms are summed from the kth downwards until they no longer count: some ten standard deviations.
    """
    k, n = k.cast("double"), n.cast("double")
    top = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    terms = F.least(k, F.ceil(10 * F.sqrt(n * p)) + 64).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0), terms), start, lambda a, i: F.struct((a["t"] * (k - i) / (n - k + i + 1) * (1 - p) / p).alias("t"), (a["s"] + a["t"]).alias("s")))["s"]
    return F.when(k < n * p, F.exp(top) * total).otherwise(F.lit(1.0))


def cutoffs(scored: DataFrame, labels: DataFrame, id_col: str, alpha: float, delta: float) -> DataFrame:
    """``stratum, rule, step``: the chosen grid step of each stratum and rule that has one.

    ``scored`` has id, ``stratum`` and ``levels``.  Labels that repeat a document count once, as good if any says so.
    """
    truth = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__of")).agg(F.max("quality").alias("__quality"))
    known = scored.join(truth, F.col(id_col) == F.col("__of")).select("stratum", (F.col("__quality") == 1).alias("good"), F.posexplode("levels").alias("rule", "level"))
    seen = known.groupBy("stratum", "rule", "level").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    steps = seen.groupBy("stratum", "rule").agg(F.sum("g").alias("n"), F.collect_list(F.struct("level", "g", "b")).alias("at"))
    steps = materialize(steps, "quality-steps")  # a row for each rule and labelled stratum
    strata = steps.agg(F.count_distinct("stratum")).first()[0]
    steps = steps.withColumn("strata", F.lit(max(1, strata)))
    upto = lambda c: F.aggregate(F.filter("at", lambda x: x["level"] <= F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x[c])
    walk = steps.select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("step")).select("stratum", "rule", "step", "n", "strata", upto("g").alias("false"), upto("b").alias("true"))
    walk = walk.withColumn("passed", binomial_tail(F.col("false"), F.col("n"), alpha / len(RULES)) <= F.lit(delta) / (len(RULES) * F.col("strata")))
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    certified = walk.withColumn("certified", F.min("passed").over(order)).where("certified")
    best = F.max_by("step", F.struct(F.col("true") - F.col("false"), -F.col("step")))
    return certified.groupBy("stratum", "rule").agg(best.alias("step"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> tuple[DataFrame, DataFrame, Column]:
    """``(measures, chosen, stratum)``: written ``__q_*`` measures of all rows, the cutoffs, and a row's stratum."""
    wanted = [c for c in dict.fromkeys((id_col, text_col, stratum_col)) if c in docs.columns]
    rows = materialize(measured(docs.select(*wanted), text_col).drop(text_col), "quality")
    lang = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col in docs.columns else F.lit("")
    ident = F.col(id_col).cast("long")
    stratum = F.concat(F.lit("="), lang)  # every language with labels has thresholds of its own
    chosen = cutoffs(rows.select(ident.alias(id_col), stratum.alias("stratum"), _levels().alias("levels")), labels, id_col, alpha, delta)
    by_stratum = chosen.groupBy(F.col("stratum").alias("__stratum")).agg(F.array(*[F.max(F.when(F.col("rule") == k, F.col("step"))) for k in range(len(RULES))]).alias("__steps"))
    return rows, by_stratum, stratum


def _levels() -> Column:
    n, lines = F.col("__q_n_words"), F.col("__q_lines")
    return F.array(_level(F.col("__q_n_symbols"), F.greatest(n, F.col("__q_n_symbols"))), _level(F.col("__q_n_repeat_words"), n), _level(lines["dup"], lines["n"]), _level(F.col("__q_capitals"), F.col("__q_word_chars")))


def decided(rows: DataFrame, chosen: DataFrame, stratum: Column) -> DataFrame:
    """Measured ``rows`` with ``__q_base_failed`` and ``__q_kept``."""
    n, levels = F.col("__q_n_words"), _levels()
    failed = (n < 10) | (100 * F.col("__q_n_repeat_words") > 20 * n)
    with_steps = rows.join(small_side(chosen), stratum == F.col("__stratum"), "left")  # a row a language with cutoffs
    rejected = reduce(lambda a, b: a | b, [F.coalesce(F.get(levels, F.lit(k)) <= F.get("__steps", F.lit(k)), F.lit(False)) for k in range(len(RULES))])
    return with_steps.withColumns({"__q_base_failed": failed, "__q_kept": ~failed & ~rejected}).drop("__stratum", "__steps")


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for every row.

    A null or empty text has no words and fails the base rules; a null language is a stratum of its own; null ids and
    repeated rows are judged like any other; labels without a document, and null labels, count nothing; without
    labels only the base rules reject.  An empty table gives an empty result.
    """
    out = decided(*judge(docs, labels, **options))
    names = {"n_words": "__q_n_words", "word_chars": "__q_word_chars", "n_symbols": "__q_n_symbols", "n_dup_lines": "__q_lines.dup", "n_repeat_words": "__q_n_repeat_words", "base_failed": "__q_base_failed", "kept": "__q_kept"}
    return out.select(F.col(options.get("id_col", "doc_id")).alias("doc_id"), *[F.col(c).alias(n) for n, c in names.items()])


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``.

    The texts are measured a second time as they pass, so no copy of them is written and none is shuffled.
    """
    _, chosen, stratum = judge(docs, labels, **options)
    # The row number keeps the filter above the measures, so each is worked out once.
    rows = measured(docs, options.get("text_col", "text")).withColumn("__q_row", F.monotonically_increasing_id())
    return decided(rows, chosen, stratum).where("__q_kept AND __q_row >= 0").select(*docs.columns)


#: DuckDB, over tables documents and labels: the same rules from the definition above.
ORACLE = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range({WINDOW}) AS s(k) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT w.r, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(ln.n, 0) AS n_lines,
             coalesce(cov.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS capitals
      FROM w LEFT JOIN cov ON cov.r = w.r LEFT JOIN ln ON ln.r = w.r),
v AS (SELECT r, doc_id, lang, unnest([0, 1, 2, 3]) AS rule, unnest([n_symbols, n_repeat_words, n_dup_lines, capitals]) AS part,
             unnest([greatest(n_words, n_symbols), n_words, n_lines, word_chars]) AS whole FROM f),
lv AS (SELECT r, doc_id, lang, rule, CASE WHEN part <= 0 THEN {GRID} ELSE greatest(0, least({GRID}, CAST(floor((whole - part) * {GRID + 1} / greatest(whole, 1)) AS INT))) END AS level FROM v),
q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT lv.lang, rule, level, q FROM lv JOIN q USING (doc_id)),
s AS (SELECT count(DISTINCT lang) AS strata FROM k),
c AS (SELECT lang, rule, step, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND level <= step) AS bad, count(*) FILTER (q <> 1 AND level <= step) AS good
      FROM k, range({GRID}) AS g(step) GROUP BY lang, rule, step),
p AS (SELECT *, CASE WHEN bad < n * {ALPHA / len(RULES)} THEN list_sum(list_transform(range(0, bad + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({ALPHA / len(RULES)}) + (n - x) * ln(1 - {ALPHA / len(RULES)})))) ELSE 1 END AS tail FROM c),
z AS (SELECT *, min(CASE WHEN tail <= {DELTA} / ({len(RULES)} * strata) THEN 1 ELSE 0 END) OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM p, s),
t AS (SELECT lang, rule, arg_max(step, (good - bad) * 1000 - step) AS step FROM z WHERE ok = 1 GROUP BY lang, rule),
x AS (SELECT DISTINCT r FROM lv JOIN t ON t.lang = lv.lang AND t.rule = lv.rule WHERE level <= step)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND r NOT IN (SELECT r FROM x) AS kept
FROM f
"""
