"""Queries T1 to T12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topk as T
from ..operators.windows import pessimistic_rank
from ..registry import query
from .fixtures import table


@query("T1_global_sort", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, 1, 2")
def t1(spark, d):
    return table(spark, d, "orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority", "o_orderstatus")


@query("T2_stable_sort_keys", "SELECT p_type, p_brand, p_size, p_name, p_partkey FROM part ORDER BY ALL")
def t2(spark, d):
    keys = ["p_type", "p_brand", "p_size", "p_name", "p_partkey"]
    return table(spark, d, "part", *keys).orderBy(*keys)


@query("T3_hash_order_sample", "SELECT c_custkey, c_name FROM customer ORDER BY sha256(CAST(c_custkey AS VARCHAR)), CAST(c_custkey AS VARCHAR) LIMIT 50")
def t3(spark, d):
    return T.hash_sample(table(spark, d, "customer", "c_custkey", "c_name"), F.col("c_custkey").cast("string"), 50)


@query("T4_rounded_argmax", """SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice, 12) DESC, p_partkey) = 1""")
def t4(spark, d):
    return T.rounded_argmax(table(spark, d, "part", "p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", F.col("p_partkey"), "p_partkey")


@query("T5_top_k_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def t5(spark, d):
    return T.top_k(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("T6_truth_in_top_k", "SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER w + count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1 <= 3 AS hit FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC)")
def t6(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return pessimistic_rank(li, "l_quantity", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("rank") <= 3).alias("hit"))


@query("T7_best_per_concept", "SELECT l_partkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1 ORDER BY best DESC, 1 LIMIT 10")
def t7(spark, d):
    return table(spark, d, "lineitem", "l_partkey", "l_extendedprice").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("best")).orderBy(F.desc("best"), "l_partkey").limit(10)


@query("T8_overlap_preselect", """WITH w AS (SELECT p_partkey, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type, p_brand]) AS t FROM part),
  q AS (SELECT p_partkey AS query_id, t FROM w WHERE p_partkey % 50 = 0),
  s AS (SELECT query_id, p_partkey, count(*) AS n FROM q JOIN w USING (t) WHERE query_id <> p_partkey GROUP BY ALL)
  SELECT query_id, p_partkey, n FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, p_partkey) <= 5""")
def t8(spark, d):
    words = F.concat(F.split("p_name", " "), F.array("p_type", "p_brand"))
    w = table(spark, d, "part").select("p_partkey", F.explode(words).alias("t"))
    q = w.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), "t")
    n = q.join(w, "t").where("query_id <> p_partkey").groupBy("query_id", "p_partkey").agg(F.count("*").alias("n"))
    return T.top_k(n, ["query_id"], [F.desc("n"), F.asc("p_partkey")], 5)


@query("T9_preference_pick", "SELECT s_nationkey, arg_min(s_suppkey, CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END * 1000000000 + s_suppkey) AS pick FROM supplier GROUP BY 1")
def t9(spark, d):
    return table(spark, d, "supplier", "s_nationkey", "s_suppkey", "s_acctbal").groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct(F.col("s_acctbal") <= 5000, "s_suppkey")).alias("pick"))


@query("T10_ordered_distinct_list", """SELECT conv_id, array_to_string(list_transform(list_sort(list({'k': k, 'role': role})), lambda x: x.role), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS k FROM conversations GROUP BY ALL) GROUP BY 1""")
def t10(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.array_join(F.array_distinct(F.transform(rows, lambda x: x["role"])), ",").alias("roles"))


@query("T11_feasible_grid_argmax", """WITH g AS (SELECT l_linestatus AS k, t, count(*) FILTER (l_discount >= t) AS kept, count(*) FILTER (l_discount >= t AND l_returnflag = 'R') AS bad FROM lineitem CROSS JOIN (VALUES (0.01), (0.03), (0.05), (0.07), (0.09)) v(t) GROUP BY ALL)
  SELECT k, CAST(t AS DOUBLE) AS t, kept FROM g WHERE bad * 10 <= kept * 4 QUALIFY row_number() OVER (PARTITION BY k ORDER BY kept DESC, t) = 1""")
def t11(spark, d):
    grid = (0.01, 0.03, 0.05, 0.07, 0.09)
    li = table(spark, d, "lineitem", "l_linestatus", "l_discount", "l_returnflag")
    one = lambda t: F.struct(F.lit(t).alias("t"), F.count_if(F.col("l_discount") >= t).alias("kept"), F.count_if((F.col("l_discount") >= t) & (F.col("l_returnflag") == "R")).alias("bad"))
    g = li.groupBy(F.col("l_linestatus").alias("k")).agg(F.array(*map(one, grid)).alias("g")).select("k", F.inline("g")).where("bad * 10 <= kept * 4")
    return g.groupBy("k").agg(F.max_by(F.struct("t", "kept"), F.struct("kept", -F.col("t"))).alias("b")).select("k", "b.t", "b.kept")


@query("T12_smallest_within_tolerance", """WITH g AS (SELECT p_brand, p_size, avg(p_retailprice) AS s FROM part GROUP BY ALL), b AS (SELECT p_brand, max(s) AS best FROM g GROUP BY 1)
  SELECT g.p_brand, min(p_size) AS p_size FROM g JOIN b ON g.p_brand = b.p_brand WHERE s >= best - 50 GROUP BY 1""")
def t12(spark, d):
    g = table(spark, d, "part", "p_brand", "p_size", "p_retailprice").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("s"))
    return T.smallest_within(g, ["p_brand"], "p_size", "s", 50.0)
