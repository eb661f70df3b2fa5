"""Relational queries: grouped, conditional and latest-per-key aggregates, joins, ledgers, windows, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import ledger as L
from ..operators import library as B
from ..operators import ranges
from .registry import query, read


def micros(ts):
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))



@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, max(value) FILTER (value <= 50) AS best_low,
 count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days, coalesce(sum(CASE WHEN value < 0 THEN 1 END), 0) AS negative FROM events GROUP BY event_type""")
def conditional_counts(spark, sf):
    """Conditional and distinct aggregates with defaults for empty groups."""
    e = read(spark, sf, "events")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.max(F.when(F.col("value") <= 50, F.col("value"))).alias("best_low"),
        F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"), F.coalesce(F.sum(F.when(F.col("value") < 0, 1)), F.lit(0)).alias("negative"),
    )


@query("""SELECT n_name, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p,
 CAST(floor(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS BIGINT) AS percent
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def pivot_status(spark, sf):
    """Counts by status as columns, zero-filled, and the share of finished ones."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = o.groupBy("n_name").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return p.select("n_name", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"), F.floor(100.0 * F.col("F") / (F.col("F") + F.col("O") + F.col("P"))).cast("long").alias("percent"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_per_key(spark, sf):
    """The newest row of each key, as one partial-friendly aggregate instead of a window."""
    row = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")
    return read(spark, sf, "orders").groupBy("o_custkey").agg(row).select("o_custkey", "r.o_orderkey", "r.o_totalprice")


@query("""WITH n AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL), s AS (SELECT user_id, sum(v) AS s FROM n GROUP BY user_id HAVING sum(v) > 0)
 SELECT coalesce(round(median(s), 6), 20.0) AS seconds, count(*) AS users FROM s""")
def newest_sum_median(spark, sf):
    """Newest value per key, summed per group, and the median of the positive sums with a fallback."""
    newest = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    m = ranges.middle(newest.groupBy("user_id").agg(F.sum("v").alias("s")).where("s > 0"), "s")
    return m.select(F.coalesce(F.round("median", 6), F.lit(20.0)).alias("seconds"), F.col("n").alias("users"))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type""")
def percentile_nearest_rank(spark, sf):
    """Nearest-rank percentiles."""
    return ranges.nearest_rank(read(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) FILTER (value > 50) AS hits, count(*) AS n FROM events GROUP BY ALL)
 SELECT event_type, round(avg(hits / n), 6) AS mean, round(min(hits / n), 6) AS low, round(max(hits / n), 6) AS high, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY event_type""")
def spread_over_groups(spark, sf):
    """Mean, least and greatest rate over runs, with pooled hits."""
    d = read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count_if(F.col("value") > 50).alias("hits"), F.count("*").alias("n"))
    rate = F.col("hits") / F.col("n")
    return d.groupBy("event_type").agg(F.round(F.avg(rate), 6).alias("mean"), F.round(F.min(rate), 6).alias("low"), F.round(F.max(rate), 6).alias("high"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))


@query("""SELECT o_custkey, 'v1:' || count(*) || ':' || count(*) FILTER (o_orderstatus = 'F') || ':' || epoch_us(max(o_orderdate)) AS stamp FROM orders GROUP BY o_custkey""")
def signature_stamp(spark, sf):
    """Index stamps: version, rows, finished rows, last change in microseconds."""
    lines = read(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), (F.col("o_orderstatus") == "F").alias("reviewed"), F.col("o_orderdate").alias("updated_at"))
    return I.stamps(lines).select(F.col("page_id").alias("o_custkey"), "stamp")


@query("""WITH s AS (SELECT user_id, count(*) || ':' || epoch_us(max(ts)) AS v FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT user_id, count(*) || ':' || epoch_us(max(ts)) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
 SELECT coalesce(s.user_id, c.user_id) AS user_id, CASE WHEN s.user_id IS NULL THEN 'added' WHEN c.user_id IS NULL THEN 'removed' WHEN s.v = c.v THEN 'same' ELSE 'changed' END AS change, s.v AS stored, c.v AS current FROM s FULL JOIN c ON s.user_id = c.user_id""")
def diff_join_changes(spark, sf):
    """Full outer comparison of stored and current signatures."""
    sig = lambda kind: read(spark, sf, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.concat_ws(":", F.count("*"), micros(F.max("ts"))).alias("sig"))
    return I.changes(sig("view"), sig("click"), "user_id", "sig")


_GRANTS = "SELECT o_custkey, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS remaining, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderdate + INTERVAL 365 DAY END AS expires_at, o_orderdate AS starts_at FROM orders"


def _grants(spark, sf):
    o = read(spark, sf, "orders")
    expires = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"))
    return o.select("o_custkey", F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("remaining"), expires.alias("expires_at"), F.col("o_orderdate").alias("starts_at"))


@query(f"""WITH g AS ({_GRANTS}), w AS (SELECT g.*, coalesce(sum(remaining) OVER (PARTITION BY o_custkey ORDER BY expires_at NULLS LAST, starts_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev, CAST(floor(greatest(c_acctbal, 0) * 50) AS BIGINT) AS owed FROM g JOIN customer ON c_custkey = o_custkey)
 SELECT o_custkey, id, CAST(greatest(0, least(remaining, owed - prev)) AS BIGINT) AS take, CAST(remaining - greatest(0, least(remaining, owed - prev)) AS BIGINT) AS "left" FROM w""")
def fifo_allocation(spark, sf):
    """Grants pay what is owed in expiry order: a prefix sum, no loop."""
    owed = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.floor(F.greatest("c_acctbal", F.lit(0)) * 50).cast("long").alias("owed"))
    return L.allocate(_grants(spark, sf), owed, "o_custkey").select("o_custkey", "id", F.col("take").cast("long").alias("take"), F.col("left").cast("long").alias("left"))


@query(f"""WITH g AS ({_GRANTS}), n AS (SELECT max(o_orderdate) AS now FROM orders), l AS (SELECT g.* FROM g, n WHERE starts_at <= now AND (expires_at IS NULL OR expires_at > now)),
 b AS (SELECT o_custkey, sum(remaining) AS live, min(expires_at) AS next FROM l GROUP BY 1), x AS (SELECT l.o_custkey, sum(remaining) AS at_next FROM l JOIN b ON b.o_custkey = l.o_custkey AND l.expires_at = b.next GROUP BY 1)
 SELECT c_custkey, CAST(coalesce(live, 0) - greatest(0, floor(-c_acctbal)) AS BIGINT) AS balance, next AS next_expiry, CAST(at_next AS BIGINT) AS at_next FROM customer LEFT JOIN b ON b.o_custkey = c_custkey LEFT JOIN x ON x.o_custkey = c_custkey""")
def live_interval_balance(spark, sf):
    """Balance of live grants less debt, and the nearest expiry with ties summed, for every account."""
    g = _grants(spark, sf)
    now = read(spark, sf, "orders").agg(F.max("o_orderdate").alias("now")).scalar()
    live = g.where(L.live(F.col("starts_at"), F.col("expires_at"), F.lit(None), now))
    by_expiry = live.groupBy("o_custkey", "expires_at").agg(F.sum("remaining").alias("r"))
    b = by_expiry.groupBy("o_custkey").agg(F.sum("r").alias("live"), F.min("expires_at").alias("next_expiry"), F.min_by("r", F.when(F.col("expires_at").isNotNull(), F.col("expires_at"))).alias("at_next"))
    balance = F.coalesce("live", F.lit(0)) - F.greatest(F.lit(0), F.floor(-F.col("c_acctbal")))
    return read(spark, sf, "customer").join(b, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", balance.cast("long").alias("balance"), "next_expiry", F.when(F.col("next_expiry").isNotNull(), F.col("at_next")).cast("long").alias("at_next"))


@query("""WITH n AS (SELECT date_trunc('month', max(ts)) AS first FROM events) SELECT user_id, round(sum(value), 4) AS used, count(*) AS calls FROM events, n WHERE ts >= first GROUP BY user_id""")
def month_to_date_usage(spark, sf):
    """Usage since the month's first day."""
    e = read(spark, sf, "events")
    first = e.agg(F.date_trunc("month", F.max("ts")).alias("m")).scalar()
    return e.where(F.col("ts") >= first).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("used"), F.count("*").alias("calls"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS calls, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) > 2 AS limited FROM events""")
def rate_limit_trailing(spark, sf):
    """Calls in the trailing hour and whether they pass the limit."""
    return read(spark, sf, "events").withColumn("calls", L.trailing_count(None, "user_id", "ts", 3600)).select("event_id", "calls", (F.col("calls") > 2).alias("limited"))


@query("""SELECT user_id, min_by(event_type, (ts, event_id)) AS first_type, min_by(value, (ts, event_id)) AS first_value, count(*) AS live FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def first_seen_revision(spark, sf):
    """The state before the first live revision of each key."""
    live = read(spark, sf, "events").where(F.col("event_type") != "error")
    order = F.struct("ts", "event_id")
    return live.groupBy("user_id").agg(F.min_by("event_type", order).alias("first_type"), F.min_by("value", order).alias("first_value"), F.count("*").alias("live"))


@query("""WITH c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS chapter FROM conversations) SELECT conv_id, turn, CAST(chapter AS BIGINT) AS chapter, row_number() OVER (PARTITION BY conv_id, chapter ORDER BY turn) AS num FROM c""")
def numbering_with_reset(spark, sf):
    """Running numbers that start again at each chapter."""
    c = B.islands(read(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "chapter")
    return c.select("conv_id", "turn", "chapter", F.row_number().over(Window.partitionBy("conv_id", "chapter").orderBy("turn")).alias("num"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS k FROM d)
 SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS days FROM g GROUP BY user_id, k""")
def gaps_and_islands(spark, sf):
    """Runs of consecutive days."""
    d = read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    gap = F.coalesce(F.datediff("day", F.lag("day").over(Window.partitionBy("user_id").orderBy("day"))), F.lit(2)) > 1
    runs = B.islands(d.withColumn("new", gap), ["user_id"], "day", F.col("new"))
    return runs.groupBy("user_id", "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).drop("island")


@query("""WITH m AS (SELECT o_custkey, median(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 3)
 SELECT m.o_custkey, round(m, 4) AS median, arg_min(o_orderkey, (abs(o_totalprice - m), o_orderkey)) AS nearest FROM m JOIN orders USING (o_custkey) GROUP BY m.o_custkey, m""")
def closest_to_median(spark, sf):
    """Median with a minimum support, and the row nearest to it."""
    o = read(spark, sf, "orders")
    m = o.groupBy("o_custkey").agg(F.median("o_totalprice").alias("m"), F.count("*").alias("n")).where("n >= 3")
    return o.join(m, "o_custkey").groupBy("o_custkey").agg(F.round(F.first("m"), 4).alias("median"), F.min_by("o_orderkey", F.struct(F.abs(F.col("o_totalprice") - F.col("m")), "o_orderkey")).alias("nearest"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, (n, -first)) AS mode, max(n) AS n FROM c GROUP BY user_id""")
def mode_first_tie(spark, sf):
    """The most frequent value; on a tie the one seen first."""
    c = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""")
def semi_scope(spark, sf):
    """Rows in a scope through several hops, by semi joins."""
    scope = read(spark, sf, "nation").join(read(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    c = read(spark, sf, "customer").join(scope, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return c.join(read(spark, sf, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_stale(spark, sf):
    """Rows without a counterpart, safe with nulls."""
    return read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT a.l_orderkey, a.l_linenumber, arg_max(b.l_linenumber, (greatest(0, least(a.l_linenumber * 10 + a.l_quantity, b.l_linenumber * 10 + b.l_quantity) - greatest(a.l_linenumber * 10, b.l_linenumber * 10)) / (greatest(a.l_linenumber * 10 + a.l_quantity, b.l_linenumber * 10 + b.l_quantity) - least(a.l_linenumber * 10, b.l_linenumber * 10)), -b.l_linenumber)) AS best
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'R' AND b.l_returnflag <> 'R'
 WHERE greatest(0, least(a.l_linenumber * 10 + a.l_quantity, b.l_linenumber * 10 + b.l_quantity) - greatest(a.l_linenumber * 10, b.l_linenumber * 10)) / (greatest(a.l_linenumber * 10 + a.l_quantity, b.l_linenumber * 10 + b.l_quantity) - least(a.l_linenumber * 10, b.l_linenumber * 10)) > 0.3 GROUP BY ALL""")
def iou_best_match(spark, sf):
    """Best overlapping box on the same page, by intersection over union."""
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_linenumber") * 10).alias("x0"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("x1"))
    a, b = l.where("l_returnflag = 'R'").alias("a"), l.where("l_returnflag <> 'R'").alias("b")
    shared = F.greatest(F.lit(0), F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0"))
    iou = shared / (F.greatest("a.x1", "b.x1") - F.least("a.x0", "b.x0"))
    met = a.join(b, F.col("a.l_orderkey") == F.col("b.l_orderkey")).where(iou > 0.3)
    return met.groupBy("a.l_orderkey", "a.l_linenumber").agg(F.max_by("b.l_linenumber", F.struct(iou, -F.col("b.l_linenumber"))).alias("best"))


@query("""WITH m AS (SELECT o_custkey, avg(o_orderkey) AS after FROM orders GROUP BY 1) SELECT m.o_custkey, arg_min(o_orderkey, (CASE WHEN o_orderkey <= after THEN 1 ELSE 0 END, o_orderkey)) AS next FROM orders JOIN m USING (o_custkey) WHERE o_orderstatus <> 'F' GROUP BY m.o_custkey""")
def wraparound_next(spark, sf):
    """The next open row after a place, beginning again at the start."""
    o = read(spark, sf, "orders")
    m = o.groupBy("o_custkey").agg(F.avg("o_orderkey").alias("after"))
    return o.where("o_orderstatus <> 'F'").join(m, "o_custkey").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.when(F.col("o_orderkey") <= F.col("after"), 1).otherwise(0), "o_orderkey")).alias("next"))


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def paging_total(spark, sf):
    """A page of a ranked list with the total before paging."""
    o = read(spark, sf, "orders")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice", o.agg(F.count("*")).scalar().alias("total"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 10""")
def prune_keep_n(spark, sf):
    """Versions beyond the newest ten."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return read(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r > 10").select("o_custkey", "o_orderkey")


@query("""SELECT l_suppkey, s_name, pages, row_number() OVER (ORDER BY pages DESC, s_name) AS rank FROM (SELECT l_suppkey, round(sum(l_quantity), 2) AS pages FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey""")
def usage_ranked(spark, sf):
    """Usage by book, the most used first, ties by title; ranked after grouping, over suppliers alone."""
    u = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("pages")).join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return ranges.ranked(u.select("l_suppkey", "s_name", "pages"), F.desc("pages"), F.asc("s_name"))


@query(f"""WITH g AS ({_GRANTS}), n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_custkey, id, -remaining AS pages, expires_at AS created_at FROM g, n WHERE expires_at <= now AND remaining > 0""")
def expiry_posting(spark, sf):
    """Negative ledger entries for what expired, dated at expiry."""
    now = read(spark, sf, "orders").agg(F.max("o_orderdate")).scalar()
    return _grants(spark, sf).where((F.col("expires_at") <= now) & (F.col("remaining") > 0)).select("o_custkey", "id", (-F.col("remaining")).alias("pages"), F.col("expires_at").alias("created_at"))


@query("""SELECT user_id, event_type, min(event_id) AS event_id, count(*) - 1 AS ignored FROM events GROUP BY user_id, event_type""")
def idempotent_consume(spark, sf):
    """One consumption per key, the first."""
    return read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("ignored"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS t, 100 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS e FROM lineitem), r AS (SELECT *, floor(e) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY 100 * q - floor(e) * t DESC, l_linenumber, l_partkey, l_suppkey) AS k, 100 - sum(floor(e)) OVER (PARTITION BY l_orderkey) AS short FROM w)
 SELECT l_orderkey, l_linenumber, l_partkey, CAST(f + CASE WHEN k <= short THEN 1 ELSE 0 END AS BIGINT) AS share FROM r""")
def largest_remainder(spark, sf):
    """Proportional split of 100 by largest remainder."""
    return L.largest_remainder(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey", "l_quantity", F.lit(100), "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", F.col("share").cast("long").alias("share"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS orders, max(o_orderdate) AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS lines, max(l_shipdate) AS last_ship FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
 SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, status, greatest(last_order, last_ship) AS last_activity FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey""")
def shelf(spark, sf):
    """The shelf: per book counts, newest state, and the latest activity of several sources."""
    o = read(spark, sf, "orders")
    by = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last_order"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    li = read(spark, sf, "lineitem").join(o.select("o_orderkey", F.col("o_custkey").alias("k")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("k").agg(F.count("*").alias("lines"), F.max("l_shipdate").alias("last_ship"))
    c = read(spark, sf, "customer").join(by, F.col("c_custkey") == F.col("o_custkey"), "left").join(li, F.col("c_custkey") == F.col("k"), "left")
    return c.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"), "status", F.greatest("last_order", "last_ship").alias("last_activity"))


@query("""SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS pages, count(*) FILTER (value > 90) AS cold, round(sum(value) / 1000, 6) AS seconds, round(sum(value) / 1000 / nullif(count(DISTINCT user_id), 0), 6) AS per_page FROM events GROUP BY event_type""")
def call_log_summary(spark, sf):
    """Calls by outcome, cold starts, distinct pages and cost a page."""
    e = read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("pages"), F.count_if(F.col("value") > 90).alias("cold"), (F.sum("value") / 1000).alias("s"))
    return e.select("event_type", "calls", "pages", "cold", F.round("s", 6).alias("seconds"), F.round(F.try_divide("s", "pages"), 6).alias("per_page"))


@query("""WITH k AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority AS code, n, coalesce(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 END, 3) AS place FROM k""")
def warnings_by_code(spark, sf):
    """Counts by code in a fixed order, unknown codes last."""
    place = {"5-LOW": 0, "1-URGENT": 1, "3-MEDIUM": 2}
    order = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("n")).withColumn("place", F.coalesce(F.try_element_at(order, "code"), F.lit(len(place))))


@query("""SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') + count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_suppkey END) AS BIGINT) AS open FROM lineitem GROUP BY l_orderkey""")
def open_items(spark, sf):
    """Open words outside groups plus distinct open groups."""
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")) + F.countDistinct(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey")))).alias("open"))


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('7:' || event_id), event_id) AS round FROM events) SELECT user_id, event_id, round FROM s""")
def round_robin(spark, sf):
    """A seeded order within each book; rounds take one of each."""
    w = Window.partitionBy("user_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")).cast("binary")), "event_id")
    return read(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).alias("round"))


@query("""WITH d AS (SELECT l_suppkey, l_shipdate, lead(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_suppkey, median((epoch_us(n) - epoch_us(l_shipdate)) / 1000000) AS pitch FROM d WHERE n IS NOT NULL GROUP BY 1""")
def line_pitch(spark, sf):
    """Median distance of consecutive rows."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    d = read(spark, sf, "lineitem").withColumn("d", (micros(F.lead("l_shipdate").over(w)) - micros("l_shipdate")) / 1000000)
    return d.where("d IS NOT NULL").groupBy("l_suppkey").agg(F.median("d").alias("pitch"))


@query("""WITH w AS (SELECT l_orderkey, l_extendedprice AS x0, l_extendedprice + l_quantity * 100 AS x1, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top, l_quantity AS q FROM lineitem) SELECT l_orderkey, round(median(x0), 4) AS "left", round(median(x1), 4) AS "right" FROM w WHERE q >= 0.6 * top GROUP BY 1""")
def text_measure(spark, sf):
    """Medians of the edges of a page's wide lines."""
    l = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + F.col("l_quantity") * 100).alias("x1"))
    wide = l.withColumn("top", F.max("q").over(Window.partitionBy("l_orderkey"))).where("q >= 0.6 * top")
    return wide.groupBy("l_orderkey").agg(F.round(F.median("x0"), 4).alias("left"), F.round(F.median("x1"), 4).alias("right"))


@query("""SELECT a.s_suppkey, b.c_custkey FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey AND b.c_acctbal BETWEEN a.s_acctbal - 10 AND a.s_acctbal + 10""")
def band_join(spark, sf):
    """A band as an equi-join: both sides by nation and stretch of twenty, one side in the two that its band can touch."""
    stretch = lambda c: F.floor(c / 20)
    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.explode(F.array_distinct(F.array(stretch(F.col("s_acctbal") - 10), stretch(F.col("s_acctbal") + 10)))).alias("band"))
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", stretch(F.col("c_acctbal")).alias("band2"))
    return s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("band") == F.col("band2")) & F.col("c_acctbal").between(F.col("s_acctbal") - 10, F.col("s_acctbal") + 10)).select("s_suppkey", "c_custkey")


@query("""SELECT DISTINCT user_id, 'both' AS side FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL (SELECT user_id, 'only' FROM events WHERE event_type = 'click' EXCEPT SELECT user_id, 'only' FROM events WHERE event_type = 'purchase')""")
def set_ops(spark, sf):
    """Intersection and difference of sets of ids."""
    ids = lambda kind: read(spark, sf, "events").where(F.col("event_type") == kind).select("user_id")
    both, only = ids("click").intersect(ids("purchase")), ids("click").subtract(ids("purchase"))
    return both.withColumn("side", F.lit("both")).union(only.withColumn("side", F.lit("only")))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_rollup(spark, sf):
    """Extension beyond the book engine: subtotals over all groupings."""
    return read(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view') SELECT p.event_id, arg_max(v.event_id, (v.ts, v.event_id)) AS last_view FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts GROUP BY p.event_id""")
def asof_join(spark, sf):
    """Extension: the last view before each purchase, as one window over both kinds (no range join)."""
    e = read(spark, sf, "events").where(F.col("event_type").isin("purchase", "view"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    view = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    return e.withColumn("v", F.max(view).over(w)).where("event_type = 'purchase'").select("event_id", F.col("v.event_id").alias("last_view"))


@query("""WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    """Extension: sessions with a gap of twelve hours."""
    return read(spark, sf, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select("user_id", F.col("w.start").alias("start"), "n", "value")
