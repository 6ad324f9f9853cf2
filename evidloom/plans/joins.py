"""Queries J1 to J22."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..registry import query
from .fixtures import CASES, OBSERVATIONS, STAYS, TOKENS, cases, observations, stays, table, tokens


@query("J1_inner_multi_key", """SELECT l_orderkey, l_linenumber, o_orderpriority, count(*) AS n, sum(CAST(round(l_quantity) AS BIGINT))::BIGINT AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def j1(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "l_linenumber", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("qty"))


@query("J2_left_join", """SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey""")
def j2(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3")
    return table(spark, d, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("J3_dictionary_lookup", """SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def j3(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("J4_fallback_lookup", """SELECT p_partkey, coalesce(a, b) AS found, CASE WHEN a IS NOT NULL THEN 'preferred' WHEN b IS NOT NULL THEN 'entry' ELSE 'none' END AS how
  FROM part LEFT JOIN (SELECT l_partkey AS k, min(l_suppkey) AS a FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 GROUP BY 1) x ON p_partkey = x.k
  LEFT JOIN (SELECT l_partkey AS k, min(l_suppkey) AS b FROM lineitem WHERE l_quantity > 45 GROUP BY 1) y ON p_partkey = y.k""")
def j4(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    tiers = [("preferred", li.where("l_returnflag = 'R' and l_quantity > 48"), "l_partkey", "l_suppkey"), ("entry", li.where("l_quantity > 45"), "l_partkey", "l_suppkey")]
    return J.fallback_lookup(table(spark, d, "part", "p_partkey"), "p_partkey", tiers)


@query("J5_semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
def j5(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_discount").where("l_discount > 0.09")
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("J6_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j6(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'")
    return table(spark, d, "customer", "c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("J7_containment_join", """SELECT n_nationkey AS nation, s_suppkey FROM nation JOIN supplier ON list_contains([CAST(s_nationkey AS VARCHAR), CAST((s_nationkey + 7) % 25 AS VARCHAR)], CAST(n_nationkey AS VARCHAR))""")
def j7(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat_ws(";", F.col("s_nationkey"), (F.col("s_nationkey") + 7) % 25).alias("ids"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_nationkey").cast("string").alias("id"))
    return J.containment_join(n, s, "id", "ids").select("nation", "s_suppkey")


@query("J8_asof_join", f"""WITH {STAYS} SELECT e.event_id, s.stay_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'signup') e
  ASOF LEFT JOIN stays s ON e.user_id = s.user_id AND e.ts >= s.intime""")
def j8(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type <> 'signup'").drop("event_type")
    return J.as_of_join(e, stays(spark, d), "user_id", "ts", "intime", "stay_id").select("event_id", F.col("match.stay_id").alias("stay_id"))


@query("J9_interval_join", f"""WITH {STAYS}, e AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'signup')
  SELECT e.event_id, s.stay_id, s.stay_id = max_by(s.stay_id, s.intime) OVER (PARTITION BY e.event_id) AS assigned
  FROM e JOIN stays s ON e.user_id = s.user_id AND e.ts BETWEEN s.intime AND s.outtime""")
def j9(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type <> 'signup'").drop("event_type")
    hit = J.interval_join(e, stays(spark, d), "user_id", "ts", "intime", "outtime")
    latest = J.as_of_join(e, stays(spark, d), "user_id", "ts", "intime", "stay_id").select("event_id", F.col("match.stay_id").alias("latest"))
    return hit.join(latest, "event_id").select("event_id", "stay_id", (F.col("stay_id") == F.col("latest")).alias("assigned"))


@query("J10_clipped_window_join", f"""WITH {STAYS} SELECT s.stay_id, count(e.event_id) AS n, min(e.ts) AS first_at FROM stays s
  LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type <> 'signup' AND e.ts BETWEEN s.intime AND least(s.intime + INTERVAL 6 HOURS, s.outtime) GROUP BY 1""")
def j10(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type <> 'signup'")
    s = stays(spark, d).withColumn("until", F.least(F.expr("intime + interval 6 hours"), F.col("outtime")))
    hit = J.interval_join(e, s, "user_id", "ts", "intime", "until").groupBy("stay_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"))
    return s.select("stay_id").join(hit, "stay_id", "left").na.fill(0, ["n"])


@query("J11_context_window", f"""WITH {STAYS} SELECT s.stay_id,
    coalesce(bool_or(e.ts >= s.intime - INTERVAL 24 HOURS AND e.ts < s.intime), false) AS pre24,
    coalesce(bool_or(e.ts > s.outtime AND e.ts <= s.outtime + INTERVAL 24 HOURS), false) AS post24
  FROM stays s LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type = 'error' AND e.ts BETWEEN s.intime - INTERVAL 24 HOURS AND s.outtime + INTERVAL 24 HOURS GROUP BY 1""")
def j11(spark, d):
    e = table(spark, d, "events", "user_id", "ts", "event_type").where("event_type = 'error'")
    s = stays(spark, d).withColumn("lo", F.expr("intime - interval 24 hours")).withColumn("hi", F.expr("outtime + interval 24 hours"))
    near = J.interval_join(e, s, "user_id", "ts", "lo", "hi").groupBy("stay_id").agg(F.bool_or(F.col("ts") < F.col("intime")).alias("pre24"), F.bool_or(F.col("ts") > F.col("outtime")).alias("post24"))
    return s.select("stay_id").join(near, "stay_id", "left").na.fill(False, ["pre24", "post24"])


@query("J12_earlier_event_exists", f"""WITH {STAYS} SELECT stay_id, user_id FROM stays s WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ts < s.intime)""")
def j12(spark, d):
    first = table(spark, d, "events", "user_id", "ts", "event_type").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("first"))
    return stays(spark, d).join(first, "user_id").where("first < intime").select("stay_id", "user_id")


@query("J13_longest_affix_match", """WITH k AS (SELECT DISTINCT substr(n_name, 1, 8) AS key FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'NATION_' UNION SELECT 'NATION_1')
  SELECT n_name, (SELECT max_by(key, length(key)) FROM k WHERE starts_with(n_name, key)) AS match FROM nation""")
def j13(spark, d):
    n = table(spark, d, "nation")
    keys = n.where("n_nationkey % 2 = 0").select(F.substring("n_name", 1, 8).alias("key")).union(spark.createDataFrame([("NATION_",), ("NATION_1",)], "key string"))
    return J.longest_affix_match(n.select("n_name"), keys, "n_name", "key", 10)


@query("J14_pairs_in_blocks", """SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON substr(a.p_name, 1, 2) = substr(b.p_name, 1, 2) AND a.p_brand = b.p_brand AND a.p_type = b.p_type
  AND a.p_partkey < b.p_partkey WHERE a.p_size = b.p_size""")
def j14(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    block = F.concat_ws("|", F.substring("p_name", 1, 2), "p_brand", "p_type")
    return J.pairs_in_blocks(p, block, "p_partkey", "p_size").where("value_a = value_b").select("a", "b")


@query("J15_shared_external_id", """SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey
  WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'A' AND a.l_quantity > 45 AND b.l_quantity > 45""")
def j15(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_quantity").where("l_returnflag = 'A' and l_quantity > 45").select("l_orderkey", "l_suppkey").distinct()
    one, two = li.select("l_orderkey", F.col("l_suppkey").alias("a")), li.select("l_orderkey", F.col("l_suppkey").alias("b"))
    return one.join(two, "l_orderkey").where("a <> b").select("a", "b").distinct()


@query("J16_dimension_product", "SELECT n_name, r_name, n_regionkey = r_regionkey AS inside FROM nation CROSS JOIN region")
def j16(spark, d):
    # Both sides are dimensions of fixed size.
    return table(spark, d, "nation").crossJoin(F.broadcast(table(spark, d, "region"))).select("n_name", "r_name", (F.col("n_regionkey") == F.col("r_regionkey")).alias("inside"))


@query("J17_set_overlap_join", f"""WITH {TOKENS} SELECT a.case_id, count(*) AS n_shared FROM (SELECT DISTINCT case_id, value FROM tokens) a
  JOIN (SELECT DISTINCT value FROM tokens WHERE case_id < 3) k USING (value) GROUP BY 1""")
def j17(spark, d):
    t = tokens(spark, d).select("case_id", "value").distinct()
    return t.join(t.where("case_id < 3").select("value").distinct(), "value", "left_semi").groupBy("case_id").agg(F.count("*").alias("n_shared"))


@query("J18_two_source_agreement", """WITH a AS (SELECT l_orderkey, max(l_returnflag) AS v FROM lineitem WHERE l_quantity > 20 GROUP BY 1), b AS (SELECT l_orderkey, max(l_returnflag) AS v FROM lineitem WHERE l_discount > 0.03 GROUP BY 1)
  SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, a.v AS left_value, b.v AS right_value,
    CASE WHEN b.v IS NULL THEN 'ONLY_LEFT' WHEN a.v IS NULL THEN 'ONLY_RIGHT' WHEN a.v = b.v THEN 'AGREE' ELSE 'CONFLICT' END AS verdict FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey""")
def j18(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity", "l_discount")
    one = li.where("l_quantity > 20").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("v"))
    two = li.where("l_discount > 0.03").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("v"))
    return J.adjudicated(one, two, "l_orderkey", "v")


J19_SQL = "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'"


@query("J19_sql_two_table_join", J19_SQL.format(orders="orders", customer="customer"))
def j19(spark, d):
    return spark.sql(J19_SQL, orders=table(spark, d, "orders"), customer=table(spark, d, "customer"))


@query("J20_paired_self_align", """SELECT l_orderkey, avg(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) AS a, avg(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS b
  FROM lineitem GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag END) = 2""")
def j20(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber")
    pick = lambda v: F.avg(F.when(F.col("l_returnflag") == v, F.col("l_linenumber")))
    return li.groupBy("l_orderkey").agg(pick("A").alias("a"), pick("N").alias("b")).where("a is not null and b is not null")


@query("J21_symmetric_pair_max", """WITH p AS (SELECT l_suppkey AS a, l_partkey % 50 AS b, l_returnflag AS e, max(l_discount) AS s FROM lineitem GROUP BY ALL)
  SELECT a, b, e, max(s) AS s FROM (SELECT a, b, e, s FROM p UNION ALL SELECT b, a, e, s FROM p) GROUP BY a, b, e""")
def j21(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_returnflag", "l_discount")
    p = li.groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b"), F.col("l_returnflag").alias("e")).agg(F.max("l_discount").alias("s"))
    return J.symmetric_max(p, "a", "b", ["e"], "s")


@query("J22_latest_known_as_of", f"""WITH {OBSERVATIONS} SELECT patient, node, status FROM (SELECT *, row_number() OVER (PARTITION BY patient, node ORDER BY recorded_at DESC, observed_at DESC, obs_id DESC) AS r
  FROM obs WHERE recorded_at <= TIMESTAMP '2024-01-15') WHERE r = 1""")
def j22(spark, d):
    known = observations(spark, d).where("recorded_at <= timestamp_ntz'2024-01-15'")
    # max_by combines before the shuffle, so a hot patient stays cheap.
    return known.groupBy("patient", "node").agg(F.max_by("status", F.struct("recorded_at", "observed_at", "obs_id")).alias("status"))
