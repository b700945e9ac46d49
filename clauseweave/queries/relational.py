"""Joins, aggregations, sorting and set operations on the star schema.

A policy is a customer, a mention a line item, a data term a brand, an actor a supplier; collect edges
are (customer, supplier, brand), negative where the line was returned; purposes are order priorities.
"""

from pyspark.sql import Window, functions as F

from clauseweave.plans.registry import CORE
from clauseweave.plans.session import table

q = CORE.add
CE = "ce AS (SELECT DISTINCT o_custkey AS policy_id, l_suppkey AS actor, p_brand AS data, CASE WHEN l_returnflag = 'R' THEN 'NOT_COLLECT' ELSE 'COLLECT' END AS key, o_orderpriority AS purpose FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def collects(spark, folder):
    """The mentions with their policy and term: parts are dimension data, joined as Spark's size estimates decide."""
    l, o, p = (table(spark, folder, t) for t in ("lineitem", "orders", "part"))
    l = l.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    j = l.join(o.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("o_custkey").alias("policy_id"), F.col("l_suppkey").alias("actor"), F.col("p_brand").alias("data"), F.when(F.col("l_returnflag") == "R", "NOT_COLLECT").otherwise("COLLECT").alias("key"), F.col("o_orderpriority").alias("purpose")).distinct()


@q("inner_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def inner_lookup(spark, folder):
    """JON-01."""
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p, s = table(spark, folder, "part").select("p_partkey", "p_brand"), table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "s_name")


@q("left_lookup", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_lookup(spark, folder):
    """JON-02: orders are counted before the join."""
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, folder, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@q("full_outer_eval", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%') SELECT coalesce(a.k, b.k) AS custkey, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b FROM a FULL JOIN b ON a.k = b.k")
def full_outer_eval(spark, folder):
    """JON-03: one aggregation instead of a join of a table with itself."""
    o = table(spark, folder, "orders")
    a, b = F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1")
    return o.where(a | b).groupBy(F.col("o_custkey").alias("custkey")).agg(F.bool_or(a).alias("in_a"), F.bool_or(b).alias("in_b"))


@q("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(spark, folder):
    """JON-04, OPT-07, OPT-14."""
    o = table(spark, folder, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@q("anti_missing", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_missing(spark, folder):
    """JON-05."""
    o = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@q("cross_terms", "SELECT n_name, p FROM nation CROSS JOIN (VALUES ('core'), ('non-core')) t(p)")
def cross_terms(spark, folder):
    """JON-06: a constant of two rows is exploded, not joined."""
    return table(spark, folder, "nation").select("n_name", F.explode(F.array(F.lit("core"), F.lit("non-core"))).alias("p"))


@q("theta_conflict", f"WITH {CE} SELECT DISTINCT a.policy_id, a.actor, a.data FROM ce a JOIN ce b ON a.policy_id = b.policy_id AND a.actor = b.actor AND a.data = b.data AND a.key = 'COLLECT' AND b.key = 'NOT_COLLECT'")
def theta_conflict(spark, folder):
    """JON-07: both statements in one group, found by one aggregation."""
    g = collects(spark, folder).groupBy("policy_id", "actor", "data").agg(F.bool_or(F.col("key") == "COLLECT").alias("p"), F.bool_or(F.col("key") == "NOT_COLLECT").alias("n"))
    return g.where("p and n").select("policy_id", "actor", "data")


@q("self_pairs", f"WITH {CE}, d AS (SELECT DISTINCT policy_id, actor, data FROM ce) SELECT a.policy_id, a.actor, a.data AS d1, b.data AS d2 FROM d a JOIN d b ON a.policy_id = b.policy_id AND a.actor = b.actor AND a.data < b.data")
def self_pairs(spark, folder):
    """JON-08: pairs of terms of one actor in one policy; the terms are 25, so a group is small."""
    g = collects(spark, folder).groupBy("policy_id", "actor").agg(F.array_sort(F.collect_set("data")).alias("d"))
    g = g.where(F.size("d") > 1).select("policy_id", "actor", F.explode(F.flatten(F.transform("d", lambda x: F.transform(F.filter("d", lambda y: y > x), lambda y: F.struct(x.alias("d1"), y.alias("d2")))))).alias("p"))
    return g.select("policy_id", "actor", "p.d1", "p.d2")


@q("range_span", "SELECT o_orderkey, count(*) AS shipped FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey")
def range_span(spark, folder):
    """JON-13, TOK-13: containment in a span, within a key."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", F.expr("o_orderdate + interval 60 days").alias("until"))
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate")
    j = l.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_shipdate").between(F.col("o_orderdate"), F.col("until")))
    return j.groupBy("o_orderkey").agg(F.count("*").alias("shipped"))


@q("implicit_sql_join", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'")
def implicit_sql_join(spark, folder):
    """JON-14, SRC-10: the SQL front end over temporary views."""
    for t in ("orders", "customer"):
        table(spark, folder, t).createOrReplaceTempView(t)
    return spark.sql("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'")


@q("distinct_sets", f"WITH {CE} SELECT policy_id, string_agg(DISTINCT purpose, '|' ORDER BY purpose) AS purposes, count(DISTINCT data) AS terms FROM ce GROUP BY policy_id")
def distinct_sets(spark, folder):
    """AGG-02."""
    return collects(spark, folder).groupBy("policy_id").agg(F.array_join(F.array_sort(F.collect_set("purpose")), "|").alias("purposes"), F.countDistinct("data").alias("terms"))


@q("ordered_collect", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '-' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS parts FROM lineitem GROUP BY l_orderkey")
def ordered_collect(spark, folder):
    """AGG-03: order is part of the collected value, never of the partitions."""
    s = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(s, lambda x: x["l_partkey"].cast("string")), "-").alias("parts"))


@q("conditional_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, bool_or(o_totalprice > 400000) AS large, bool_and(o_totalprice > 0) AS positive, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL")
def conditional_counts(spark, folder):
    """AGG-05, AGG-06, AGG-07."""
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.bool_or(F.col("o_totalprice") > 400000).alias("large"), F.bool_and(F.col("o_totalprice") > 0).alias("positive"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@q("last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def last_wins(spark, folder):
    """AGG-08."""
    k = F.struct("o_orderdate", "o_orderkey")
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", k).alias("last_order"), F.min_by("o_orderkey", k).alias("first_order"))


@q("having_counts", f"WITH {CE} SELECT data, count(DISTINCT policy_id) AS policies FROM ce GROUP BY data HAVING count(DISTINCT policy_id) > 10")
def having_counts(spark, folder):
    """AGG-09."""
    return collects(spark, folder).groupBy("data").agg(F.countDistinct("policy_id").alias("policies")).where("policies > 10")


@q("row_normalise", "SELECT o_orderpriority, o_orderstatus, n, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 8) AS share FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
def row_normalise(spark, folder):
    """AGG-14."""
    n = table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderpriority")), 8))


@q("multi_key_sort_topk", f"WITH {CE}, n AS (SELECT key, actor, data, count(*) AS n FROM ce GROUP BY ALL) SELECT key, actor, data, n FROM n ORDER BY n DESC, key, actor <> 1, actor, data LIMIT 100")
def multi_key_sort_topk(spark, folder):
    """SRT-01, SRT-02, SRT-07: a top-k report; each task keeps its hundred."""
    n = collects(spark, folder).groupBy("key", "actor", "data").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "key", F.col("actor") != 1, "actor", "data").limit(100)


@q("best_status_rank", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) = 1")
def best_status_rank(spark, folder):
    """SRT-04, SRT-05: all rows of the best class of a group."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.rank().over(w).alias("r")).where("r = 1").drop("r")


@q("first_match", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def first_match(spark, folder):
    """SRT-06."""
    return table(spark, folder, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@q("hash_shuffle", "SELECT doc_id, md5('7|' || doc_id) AS position FROM documents")
def hash_shuffle(spark, folder):
    """SRT-09: a random order that any partitioning repeats, as a sort key."""
    return table(spark, folder, "documents").select("doc_id", F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))).alias("position"))


@q("set_intersect", "SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(spark, folder):
    """SET-01."""
    return table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(table(spark, folder, "supplier").where("s_acctbal > 0").select("s_suppkey"))


@q("set_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def set_union(spark, folder):
    """SET-02."""
    return table(spark, folder, "nation").select(F.col("n_name").alias("name")).union(table(spark, folder, "region").select("r_name")).distinct()


@q("set_except", "SELECT s_suppkey AS k FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 45")
def set_except(spark, folder):
    """SET-03."""
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k")).subtract(table(spark, folder, "lineitem").where("l_discount > 0.09 and l_quantity > 45").select("l_suppkey"))


@q("disjoint_sets", f"WITH {CE}, s AS (SELECT policy_id, actor, list(DISTINCT purpose) FILTER (key = 'COLLECT') AS p, list(DISTINCT purpose) FILTER (key = 'NOT_COLLECT') AS n FROM ce GROUP BY ALL) SELECT policy_id, actor, NOT list_has_any(p, n) AS disjoint_purposes FROM s WHERE p IS NOT NULL AND n IS NOT NULL")
def disjoint_sets(spark, folder):
    """SET-04."""
    s = collects(spark, folder).groupBy("policy_id", "actor").agg(F.collect_set(F.when(F.col("key") == "COLLECT", F.col("purpose"))).alias("p"), F.collect_set(F.when(F.col("key") == "NOT_COLLECT", F.col("purpose"))).alias("n"))
    return s.where((F.size("p") > 0) & (F.size("n") > 0)).select("policy_id", "actor", (~F.arrays_overlap("p", "n")).alias("disjoint_purposes"))


@q("grand_totals", "SELECT coalesce(r_name, 'all') AS region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)")
def grand_totals(spark, folder):
    """AGG-17: rollup to a grand total."""
    c = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    g = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name").agg(F.sum("n").alias("customers"), F.round(F.sum("b"), 2).alias("balance"))
    return g.select(F.coalesce("r_name", F.lit("all")).alias("region"), "customers", "balance")


@q("events_tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling_window(spark, folder):
    """The batch form of the streaming window."""
    g = table(spark, folder, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start_at"), "event_type", "n", "total")


@q("events_session_window", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s) SELECT user_id, min(ts) AS start_at, count(*) AS n FROM g GROUP BY user_id, sid")
def events_session_window(spark, folder):
    """Sessions of each user with gaps of six hours."""
    g = table(spark, folder, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start_at"), "n")
