"""Relational and windowed queries that any engine over these tables needs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.plans.catalogue import E, events, query, r6, table


@query("join_inner", "SELECT c_custkey, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def join_inner(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.where("c_acctbal > 0").join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name", "c_acctbal")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def join_left(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("join_full", "SELECT c_nationkey, s_nationkey, nc, ns FROM (SELECT c_nationkey, count(*) AS nc FROM customer WHERE c_nationkey < 15 GROUP BY ALL) FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier WHERE s_nationkey > 8 GROUP BY ALL) ON c_nationkey = s_nationkey")
def join_full(spark, sf):
    c = table(spark, sf, "customer").where("c_nationkey < 15").groupBy("c_nationkey").agg(F.count("*").alias("nc"))
    s = table(spark, sf, "supplier").where("s_nationkey > 8").groupBy("s_nationkey").agg(F.count("*").alias("ns"))
    return c.join(s, c.c_nationkey == s.s_nationkey, "full").select("c_nationkey", "s_nationkey", "nc", "ns")


@query("star_revenue", "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_revenue(spark, sf):
    l, o, c, n, r = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf):
    l = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ'1998-09-02 00:00:00'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


SETS = "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::TINYINT AS g1, grouping(l_linestatus)::TINYINT AS g2 FROM lineitem GROUP BY "


def _sets(df):
    return df.agg(F.count("*").alias("n"), F.grouping("l_returnflag").alias("g1"), F.grouping("l_linestatus").alias("g2"))


@query("cube", SETS + "CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf):
    return _sets(table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus"))


@query("rollup", SETS + "ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf):
    return _sets(table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query("grouping_sets", SETS + "GROUPING SETS ((l_returnflag), (l_linestatus))")
def grouping_sets(spark, sf):
    l = table(spark, sf, "lineitem")
    return _sets(l.groupingSets([[l.l_returnflag], [l.l_linestatus]], l.l_returnflag, l.l_linestatus))


@query("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query("except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def except_all(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).exceptAll(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("rank_family", "SELECT c_custkey, (rank() OVER w)::INTEGER AS r, (dense_rank() OVER w)::INTEGER AS d, (ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey))::INTEGER AS q FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
def rank_family(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy("c_nationkey")
    q = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(q).alias("q"))


@query("window_frames", "SELECT o_orderkey, lead(o_orderkey) OVER w AS nxt, round(avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS ma FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_frames(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("nxt"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("ma"))


@query("top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def top_k_per_group(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("k", F.row_number().over(w)).where("k <= 2").select("o_custkey", "o_orderkey")


@query("json_props", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_props(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").k.alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"))


@query("count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_distinct(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("approx_distinct")
def approx_distinct(spark, sf):
    return table(spark, sf, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("pivot_status", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def pivot_status(spark, sf):
    out = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return out.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")))


@query("exact_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
def exact_percentile(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(r6(F.percentile("value", 0.5)).alias("median"))


@query("having_orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_orders(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("date_parts", "SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, count(*) AS n FROM orders GROUP BY ALL")
def date_parts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


@query("string_functions", "SELECT p_partkey, upper(p_name) AS u, length(p_type)::INTEGER AS l, split_part(p_type, ' ', 1) AS head FROM part")
def string_functions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("u"), F.length("p_type").alias("l"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head"))


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def scalar_subquery(spark, sf):
    p = table(spark, sf, "part")
    return p.crossJoin(F.broadcast(p.agg(F.avg("p_retailprice").alias("a")))).where("p_retailprice > a").select("p_partkey")


HOUR = 3_600_000_000


@query("tumbling_windows", f"WITH {E} SELECT event_type, t_us // {HOUR} * {HOUR} AS start_us, count(*) AS n FROM e GROUP BY ALL")
def tumbling_windows(spark, sf):
    e = events(spark, sf)
    return e.groupBy("event_type", (F.col("t_us") - F.col("t_us") % HOUR).alias("start_us")).agg(F.count("*").alias("n"))


@query("window_function", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start_ts, count(*) AS n FROM events GROUP BY ALL")
def window_function(spark, sf):
    w = table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.col("window.start").alias("start_ts"), "n")


@query("sliding_windows", f"WITH {E}, w AS (SELECT event_type, value, unnest([t_us // (6 * {HOUR}) * 6 * {HOUR}, t_us // (6 * {HOUR}) * 6 * {HOUR} - 6 * {HOUR}]) AS start_us FROM e) SELECT event_type, start_us, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def sliding_windows(spark, sf):
    step = 6 * HOUR
    first = F.col("t_us") - F.col("t_us") % step
    e = events(spark, sf).withColumn("start_us", F.explode(F.array(first, first - step)))
    return e.groupBy("event_type", "start_us").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("session_windows", f"WITH {E}, g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us) < {6 * HOUR} THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(t_us) AS start_us, count(*) AS n FROM s GROUP BY user_id, sid")
def session_windows(spark, sf):
    e = events(spark, sf)
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.min("t_us").alias("start_us"))
    return s.select("user_id", "start_us", "n")
