"""Queries U1 to U10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as U
from ..operators.windows import first_row
from ..registry import query
from .fixtures import OBSERVATIONS, observations, table


@query("U1_bag_union", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem WHERE l_linenumber = 1")
def u1(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_linenumber").where("l_linenumber = 1")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).unionByName(li.select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status")))


@query("U2_tagged_edge_union", "SELECT c_custkey AS src, c_nationkey AS dst, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier")
def u2(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"))
    return U.tagged_union({"customer": c, "supplier": s})


@query("U3_distinct_keep_first", "SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1")
def u3(spark, d):
    return first_row(table(spark, d, "part", "p_brand", "p_type", "p_partkey"), ["p_brand", "p_type"], ["p_partkey"])


@query("U4_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def u4(spark, d):
    return U.duplicates(table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("U5_set_operations", """(SELECT 'both' AS op, l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT 'both', l_partkey FROM lineitem WHERE l_returnflag = 'R')
  UNION ALL (SELECT 'minus', l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT 'minus', l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def u5(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_returnflag")
    a, r = (li.where(F.col("l_returnflag") == f).select("l_partkey") for f in "AR")
    return U.tagged_union({"both": a.intersect(r), "minus": a.subtract(r)}, "op")


@query("U6_symmetric_difference", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'MISSING' ELSE 'EXTRA' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a
  FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def u6(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "k")
    return U.symmetric_difference(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "k")


@query("U7_partition_coverage", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def u7(spark, d):
    return U.partition_faults(table(spark, d, "orders", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus")


@query("U8_conflict_dropping_dedupe", "SELECT l_partkey, min_by(l_orderkey, l_orderkey * 100 + l_linenumber) AS l_orderkey, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1")
def u8(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linestatus", "l_linenumber").withColumn("k", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return U.without_conflicts(li, "l_partkey", "l_linestatus", "k").select("l_partkey", "l_orderkey", "l_linestatus")


@query("U9_merge_existing_wins", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, -c_acctbal FROM customer WHERE c_custkey % 3 = 0")
def u9(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_acctbal")
    return U.merged(c.where("c_custkey % 3 <> 0"), c.select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal")), "c_custkey")


@query("U10_power_set", f"""WITH {OBSERVATIONS}, k AS (SELECT patient, list_sort(list(DISTINCT node)) AS s FROM obs WHERE status = 'POSITIVE' GROUP BY 1)
  SELECT patient, array_to_string(list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 1), '+') AS subset FROM k, range(1, 32) r(m) WHERE m < (1 << len(s))""")
def u10(spark, d):
    # Types are a vocabulary of at most five, so each patient has 31 subsets at most.
    s = observations(spark, d).where("status = 'POSITIVE'").groupBy("patient").agg(F.sort_array(F.collect_set("node")).alias("s"))
    masks = s.withColumn("m", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, size(s)) - 1"))))
    return masks.select("patient", F.expr("array_join(filter(s, (x, i) -> shiftright(m, i) & 1 = 1), '+')").alias("subset"))


@query("SNK9_upsert_by_key", "SELECT c_custkey, -c_acctbal AS c_acctbal FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 5 <> 0")
def snk9(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_acctbal")
    return U.upserted(c, c.where("c_custkey % 5 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal")), "c_custkey")
