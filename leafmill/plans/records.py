"""Queries on records: look-ups, leases, states, JSON paths, reports, ranks, matches, paragraphs, fingerprints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import records as R
from .registry import query, read


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7""")
def point_lookup(spark, sf):
    """One row by its key."""
    return R.lookup(read(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 7)


@query("""WITH n AS (SELECT max(o_orderdate) AS now FROM orders), c AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS claimed FROM orders)
 SELECT o_orderkey, coalesce(claimed > now - INTERVAL 720 HOUR, false) AS held FROM c, n""")
def lease_held(spark, sf):
    """Claims younger than 720 hours hold; all others, never claimed ones too, are free."""
    o = read(spark, sf, "orders")
    now = o.agg(F.max("o_orderdate")).scalar()
    return o.select("o_orderkey", R.held(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")), now, 720).alias("held"))


@query("""SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN NULL WHEN count(*) FILTER (o_orderstatus = 'P') = count(o_orderkey) THEN 'doubtful' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'reviewed' ELSE 'unreviewed' END AS state
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def change_states(spark, sf):
    """State of a change by its words; null without words."""
    by = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return read(spark, sf, "customer").join(by, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", R.change_state(F.col("n"), F.col("p"), F.col("f")).alias("state"))


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(json_extract_string(props, '$.run.stats')) AS stats FROM events GROUP BY ALL""")
def json_paths(spark, sf):
    """Values at JSON paths, null where a path is absent."""
    at = lambda path: F.get_json_object("props", path)
    return read(spark, sf, "events").groupBy("event_type", at("$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.count(at("$.run.stats")).alias("stats"))


@query("""SELECT o_custkey, count(DISTINCT o_orderkey) AS pages, count(*) AS words, count(*) FILTER (l_returnflag = 'R') AS flagged, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS unresolved,
 round(count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') / nullif(count(*) FILTER (l_returnflag = 'R'), 0), 6) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def review_summary(spark, sf):
    """Flagged and unresolved words of each book with the open share."""
    l = read(spark, sf, "lineitem").join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    flagged = F.col("l_returnflag") == "R"
    by = l.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("pages"), F.count("*").alias("words"), F.count_if(flagged).alias("flagged"), F.count_if(flagged & (F.col("l_linestatus") == "O")).alias("unresolved"))
    return by.withColumn("share", F.round(F.try_divide("unresolved", "flagged"), 6))


@query("""WITH s AS (SELECT l_returnflag AS engine, l_linestatus AS variant, l_suppkey AS sample, round(avg(l_discount), 9) AS cer FROM lineitem GROUP BY ALL),
 b AS (SELECT engine, sample, arg_min(variant, (cer, variant)) AS best FROM s GROUP BY ALL)
 SELECT s.engine, s.variant, count(*) AS samples, round(avg(cer), 6) AS mean_cer, count(*) FILTER (best = variant) AS wins FROM s JOIN b USING (engine, sample) GROUP BY ALL""")
def macro_means(spark, sf):
    """Mean error by engine and variant over samples, and how often a variant is the sample's best."""
    key = [F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("variant"), F.col("l_suppkey").alias("sample")]
    s = read(spark, sf, "lineitem").groupBy(*key).agg(F.round(F.avg("l_discount"), 9).alias("cer"))
    best = s.groupBy("engine", "sample").agg(F.min_by("variant", F.struct("cer", "variant")).alias("best"))
    return s.join(best, ["engine", "sample"]).groupBy("engine", "variant").agg(F.count("*").alias("samples"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.count_if(F.col("best") == F.col("variant")).alias("wins"))


@query("""SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, round(percent_rank() OVER w, 6) AS share, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def rank_forms(spark, sf):
    """Extension: the ranking functions within each key."""
    w, all_ = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return read(spark, sf, "orders").select("o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.round(F.percent_rank().over(w), 6).alias("share"), F.ntile(4).over(all_).alias("quarter"))


@query("""SELECT o_orderkey, CAST(greatest(0, o_custkey - 5 - 3) * greatest(1, o_orderkey % 3) AS BIGINT) AS pages, CAST(ceil(o_totalprice / 60) AS BIGINT) AS minutes FROM orders""")
def upload_pages(spark, sf):
    """Pages of an upload less those cut at either end, times pages a sheet; seconds as begun minutes."""
    pages = F.greatest(F.lit(0), F.col("o_custkey") - 5 - 3) * F.greatest(F.lit(1), F.col("o_orderkey") % 3)
    return read(spark, sf, "orders").select("o_orderkey", pages.cast("long").alias("pages"), F.ceil(F.col("o_totalprice") / 60).cast("long").alias("minutes"))


@query("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events WHERE event_type = 'click'), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events WHERE event_type = 'view')
 SELECT l.user_id, l.rank, l.event_id AS left_id, r.event_id AS right_id FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.rank = l.rank""")
def match_by_rank(spark, sf):
    """One-to-one matching of equal keys in order."""
    kind = lambda k: read(spark, sf, "events").where(F.col("event_type") == k)
    return R.match_by_rank(kind("click"), kind("view"), ["user_id"], "event_id")


@query("""WITH w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER p AS role, lag(value) OVER p AS v FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id)),
 s AS (SELECT *, CASE WHEN role IS NULL OR role <> event_type OR (event_type <> 'error' AND v < 20) THEN 1 ELSE 0 END AS begins FROM w)
 SELECT user_id, event_id, CAST(sum(begins) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS paragraph FROM s""")
def paragraph_ids(spark, sf):
    """Paragraphs of consecutive lines, by role and short lines."""
    e = read(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return R.paragraphs(e, "user_id", "event_id", "event_type", F.col("value") < 20, "error").select("user_id", "event_id", "paragraph")


@query(rf"""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM conversations),
 u AS (SELECT conv_id, turn, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS token FROM t)
 SELECT conv_id, turn, token, unnest(regexp_extract_all(w, '[{R.WORD_CLASS}]+|[^{R.WORD_CLASS}]+')) AS piece FROM u""")
def piece_split(spark, sf):
    """Words and the punctuation split off them, with the index of the token that each comes from."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(R.split_pieces(F.col("text"))).alias("token", "pieces"))
    return c.select("conv_id", "turn", "token", F.explode("pieces").alias("piece"))


@query("""SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def ready_books(spark, sf):
    """Books with pages of which none is open."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    on = F.col("c_custkey") == F.col("o_custkey")
    return read(spark, sf, "customer").select("c_custkey").join(o.where("o_orderstatus <> 'P'"), on, "left_semi").join(o.where("o_orderstatus = 'P'"), on, "left_anti").distinct()


@query("""SELECT user_id, sha1(string_agg(event_type, ',' ORDER BY event_id)) AS fingerprint, true AS repeatable FROM events GROUP BY user_id""")
def repeatable_verdicts(spark, sf):
    """Fingerprints of results, and whether a second run over other partitions gives the same."""
    e = read(spark, sf, "events").select("user_id", "event_id", "event_type")
    again = R.fingerprint(e.repartition("event_id"), "user_id", "event_id", "event_type").withColumnRenamed("fingerprint", "again")
    return R.fingerprint(e, "user_id", "event_id", "event_type").join(again, "user_id").select("user_id", "fingerprint", (F.col("fingerprint") == F.col("again")).alias("repeatable"))


@query("""SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'reviewed' WHEN bool_or(l_linestatus = 'F') THEN 'partly_reviewed' ELSE 'unreviewed' END AS state FROM lineitem GROUP BY l_orderkey""")
def span_states(spark, sf):
    """Review state of a span of words."""
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(R.span_state(F.col("l_linestatus") == "F").alias("state"))
