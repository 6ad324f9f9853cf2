"""Queries PF1 to PF14: projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import predicates as P
from ..registry import query
from .fixtures import STAYS, TOKENS, stays, table, tokens


@query("PF1_derived_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def pf1(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("PF2_rename_drop_assign", "SELECT c_custkey AS id, c_name AS name, 'customer' AS pool FROM customer")
def pf2(spark, d):
    return table(spark, d, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name"}).drop("c_nationkey", "c_acctbal", "c_mktsegment").withColumn("pool", F.lit("customer"))


@query("PF3_boolean_filter", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR NOT (o_orderpriority <> '1-URGENT')")
def pf3(spark, d):
    return table(spark, d, "orders").where(((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)) | ~(F.col("o_orderpriority") != "1-URGENT")).select("o_orderkey")


@query("PF4_in_list", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#7', 'Brand#12')")
def pf4(spark, d):
    return table(spark, d, "part", "p_partkey", "p_brand").where(F.col("p_brand").isin("Brand#1", "Brand#7", "Brand#12"))


@query("PF5_column_allow_list", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def pf5(spark, d):
    return P.only(table(spark, d, "orders"), ["o_orderkey", "o_orderdate", "o_totalprice"])


@query("PF6_versioned_code_classes", r"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(p_brand, '^Brand#1') AND p_size % 2 = 0 THEN 'ONE' END, CASE WHEN regexp_matches(p_brand, '^Brand#2[0-4]') AND p_size % 2 = 1 THEN 'TWO' END,
  CASE WHEN regexp_matches(p_brand, '5$') AND p_size % 2 = 0 THEN 'FIVE' END], lambda x: x IS NOT NULL), ',') AS classes FROM part""")
def pf6(spark, d):
    table_ = [("ONE", 0, "^Brand#1"), ("TWO", 1, "^Brand#2[0-4]"), ("FIVE", 0, "5$")]
    return table(spark, d, "part", "p_partkey", "p_brand", "p_size").select("p_partkey", F.array_join(P.code_classes(F.col("p_size") % 2, F.col("p_brand"), table_), ",").alias("classes"))


@query("PF7_first_match_cascade", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'LARGE' WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SOON' ELSE 'LATER' END AS route FROM orders")
def pf7(spark, d):
    route = P.first_match([(F.col("o_totalprice") > 400000, "LARGE"), (F.col("o_orderstatus") == "F", "DONE"), (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "SOON")], "LATER")
    return table(spark, d, "orders").select("o_orderkey", route.alias("route"))


@query("PF8_all_reasons", """SELECT o_orderkey, array_to_string(r, ',') AS reasons, len(r) = 0 AS eligible FROM (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 50000 THEN 'SMALL' END, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' END,
  CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'OLD' END], lambda x: x IS NOT NULL) AS r FROM orders)""")
def pf8(spark, d):
    reasons = P.all_reasons({"SMALL": F.col("o_totalprice") < 50000, "PENDING": F.col("o_orderstatus") == "P", "OLD": F.expr("o_orderdate < timestamp_ntz'1996-01-01'")})
    return table(spark, d, "orders").select("o_orderkey", reasons.alias("r")).select("o_orderkey", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("eligible"))


@query("PF9_range_to_null", "SELECT event_id, CASE WHEN value BETWEEN 2 AND 30 THEN value END AS value FROM events")
def pf9(spark, d):
    return table(spark, d, "events", "event_id", "value").select("event_id", P.in_range(F.col("value"), 2, 30).alias("value"))


#: Questions with their parents: E_2 opens E_5, E_3 opens E_6, E_9 has no parent.
QUESTIONS = [("E_5", "E_2"), ("E_6", "E_3"), ("E_1", None), ("E_9", None)]


@query("PF10_parent_gated_eligibility", f"""WITH {TOKENS}, q(code, parent) AS (VALUES ('E_5', 'E_2'), ('E_6', 'E_3'), ('E_1', NULL), ('E_9', NULL)), c AS (SELECT DISTINCT case_id FROM tokens)
  SELECT c.case_id, q.code FROM c CROSS JOIN q WHERE NOT EXISTS (SELECT 1 FROM tokens t WHERE t.case_id = c.case_id AND t.code = q.code) AND (q.parent IS NULL OR EXISTS (SELECT 1 FROM tokens t WHERE t.case_id = c.case_id AND t.code = q.parent AND t.value IN ('O', 'V_4')))""")
def pf10(spark, d):
    q = spark.createDataFrame(QUESTIONS, "code string, parent string")
    t = tokens(spark, d)
    # One row per case with its answers; the small question table is tested against it.
    state = t.groupBy("case_id").agg(F.collect_set("code").alias("asked"), F.collect_set(F.when(F.col("value").isin("O", "V_4"), F.col("code"))).alias("positive"))
    open_ = ~F.array_contains("asked", F.col("code")) & (F.col("parent").isNull() | F.array_contains("positive", F.col("parent")))
    return state.crossJoin(F.broadcast(q)).where(open_).select("case_id", "code")  # four questions


@query("PF11_ablation_masks", f"""WITH {TOKENS}, a(ablation, code) AS (VALUES ('full', 'E_1'), ('full', 'E_2'), ('full', 'E_3'), ('no_flag', 'E_2'), ('no_flag', 'E_3'), ('only_qty', 'E_3')) SELECT ablation, case_id, count(*) AS n FROM tokens JOIN a USING (code) GROUP BY ALL""")
def pf11(spark, d):
    masks = {"full": ["E_1", "E_2", "E_3"], "no_flag": ["E_2", "E_3"], "only_qty": ["E_3"]}
    t = tokens(spark, d).withColumn("ablation", F.explode(F.array_compact(F.array(*[F.when(F.col("code").isin(codes), F.lit(name)) for name, codes in masks.items()]))))
    return t.groupBy("ablation", "case_id").agg(F.count("*").alias("n"))


@query("PF12_two_time_gate", f"""WITH {STAYS} SELECT e.event_id, s.stay_id FROM events e JOIN stays s ON e.user_id = s.user_id AND e.ts BETWEEN s.intime AND s.outtime
  WHERE e.event_type = 'purchase' AND e.ts + to_hours(CAST(e.event_id % 12 AS INT)) <= s.intime + INTERVAL 6 HOURS AND (e.event_id % 4 = 0 OR e.ts + INTERVAL 1 HOUR >= s.intime)""")
def pf12(spark, d):
    from ..operators.joins import interval_join

    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type = 'purchase'")
    e = e.withColumn("stored", F.col("ts") + F.make_interval(hours=(F.col("event_id") % 12).cast("int"))).withColumn("charted", F.when(F.col("event_id") % 4 != 0, F.expr("ts + interval 1 hour")))
    hit = interval_join(e, stays(spark, d), "user_id", "ts", "intime", "outtime")
    return hit.where("stored <= intime + interval 6 hours and (charted is null or charted >= intime)").select("event_id", "stay_id")


@query("PF13_policy_grid", """SELECT b AS policy, CAST(t AS DOUBLE) AS t, count(*) FILTER (l_discount >= t) AS accepted, count(*) FILTER (b = 'B2' AND l_discount < t AND l_tax > 0.05) AS asked FROM lineitem CROSS JOIN (VALUES ('B1'), ('B2')) p(b) CROSS JOIN (VALUES (0.02), (0.05), (0.08)) g(t) GROUP BY ALL""")
def pf13(spark, d):
    # The grid is made of conditional counts in one pass; rows are not multiplied by it.
    li = table(spark, d, "lineitem", "l_discount", "l_tax")
    cells = [F.struct(F.lit(b).alias("policy"), F.lit(t).alias("t"), F.count_if(F.col("l_discount") >= t).alias("accepted"), F.count_if((F.lit(b) == "B2") & (F.col("l_discount") < t) & (F.col("l_tax") > 0.05)).alias("asked")) for b in ("B1", "B2") for t in (0.02, 0.05, 0.08)]
    return li.agg(F.array(*cells).alias("g")).select(F.inline("g"))


@query("PF14_forbidden_vocabulary", """WITH v(word) AS (VALUES ('red'), ('rod'), ('ring')), s AS (SELECT p_partkey, 'name' AS field, p_name AS text FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part)
  SELECT p_partkey, field, word FROM s JOIN v ON list_contains(string_split(text, ' '), word)""")
def pf14(spark, d):
    s = table(spark, d, "part", "p_partkey", "p_name", "p_brand").unpivot("p_partkey", ["p_name", "p_brand"], "field", "text")
    words = s.select("p_partkey", F.replace("field", F.lit("p_")).alias("field"), F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    return words.where(F.col("word").isin("red", "rod", "ring"))
