"""Queries V1 to V8: validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from ..operators.simulation import case_posteriors
from ..operators.windows import first_row
from ..registry import query
from .fixtures import STAYS, evidence, likelihood, observations, stays, table


@query("V1_input_digest")
def v1(spark, d):
    return V.row_digest(table(spark, d, "orders", "o_orderkey", "o_totalprice"))


@query("V2_output_vocabulary", "SELECT 'o_orderstatus' AS path, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION SELECT 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def v2(spark, d):
    words = spark.createDataFrame([("F",), ("O",), ("1-URGENT",), ("2-HIGH",)], "word string")
    return V.outside_vocabulary(table(spark, d, "orders", "o_orderstatus", "o_orderpriority"), words, "word")


@query("V3_referential_rules", "SELECT l_orderkey, l_linenumber, 'NO_PART' AS fault FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) UNION ALL SELECT l_orderkey, l_linenumber, 'NO_SUPPLIER' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def v3(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = V.dangling(li, "l_partkey", table(spark, d, "part", "p_partkey", "p_size").where("p_size <= 45"), "p_partkey")
    s = V.dangling(li, "l_suppkey", table(spark, d, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal > 0"), "s_suppkey")
    return p.select("l_orderkey", "l_linenumber", F.lit("NO_PART").alias("fault")).unionByName(s.select("l_orderkey", "l_linenumber", F.lit("NO_SUPPLIER").alias("fault")))


@query("V4_functional_dependency", "SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n FROM orders GROUP BY 1 HAVING n > 1")
def v4(spark, d):
    return V.disagreeing(table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("V5_join_cardinality", "SELECT o.o_orderkey, 1::BIGINT AS n_before, count(l_orderkey) AS n_after FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 1")
def v5(spark, d):
    o = table(spark, d, "orders", "o_orderkey")
    after = o.join(table(spark, d, "lineitem", "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey")
    return V.changed_cardinality(o, after, ["o_orderkey"])


@query("V6_leakage_probe", "SELECT 0::BIGINT AS n_changed")
def v6(spark, d):
    """Knowledge that comes after the cut-off is changed; the view before it must stay as it is."""
    view = lambda o: o.where("recorded_at <= timestamp_ntz'2024-01-15'").groupBy("patient", "node").agg(F.max_by("status", F.struct("recorded_at", "observed_at", "obs_id")).alias("status"))
    o = observations(spark, d)
    changed = o.withColumn("status", F.when(F.expr("recorded_at > timestamp_ntz'2024-01-15'"), F.lit("NEGATIVE")).otherwise(F.col("status")))
    return V.differing(view(o), view(changed)).agg(F.count("*").alias("n_changed"))


@query("V7_independent_recomputation", "SELECT count(*) AS n, true AS within FROM (SELECT l_suppkey FROM lineitem GROUP BY 1)")
def v7(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_quantity")
    a = li.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"))
    b = li.groupBy("l_suppkey").agg((F.sum("l_quantity") / F.count("l_quantity")).alias("m"))
    return V.largest_gap(a, b, ["l_suppkey"], "m").select("n", (F.col("gap") < 1e-9).alias("within"))


@query("V8_cohort_equality", f"""WITH {STAYS}, a AS (SELECT user_id, min(intime) AS t FROM stays GROUP BY 1), b AS (SELECT user_id, min(intime) AS t FROM stays WHERE stay_id % 10 <> 0 GROUP BY 1)
  SELECT user_id, t, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT user_id, t, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def v8(spark, d):
    s = stays(spark, d)
    one = first_row(s, ["user_id"], ["intime", "stay_id"]).select("user_id", F.col("intime").alias("t"))
    two = s.where("stay_id % 10 <> 0").groupBy("user_id").agg(F.min("intime").alias("t"))
    return V.differing(one, two)


@query("V7_posterior_sums_to_one", "SELECT true AS within")
def v7_posterior(spark, d):
    post = case_posteriors(evidence(spark, d), likelihood(spark, d), "case_id", ["code", "value"], "label", once=True)
    total = F.aggregate("post", F.lit(0.0), lambda acc, x: acc + x["p"])
    return post.agg((F.max(F.abs(total - 1)) < 1e-9).alias("within"))
