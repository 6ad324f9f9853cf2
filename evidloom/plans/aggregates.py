"""Queries A1 to A21: counts, summaries, likelihoods, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..registry import query
from .fixtures import CASES, LIKELIHOOD, TOKENS, cases, evidence, likelihood, table, tokens


@query("A1_group_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a1(spark, d):
    return table(spark, d, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@query("A2_named_aggregates", "SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) AS mean_cents, min(o_orderstatus) AS w FROM orders GROUP BY 1")
def a2(spark, d):
    # Whole cents, so that the mean does not depend on the order of the sum.
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderstatus").groupBy("o_custkey").agg((F.sum(cents) / F.count("*")).alias("mean_cents"), F.min("o_orderstatus").alias("w"))


@query("A3_distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def a3(spark, d):
    return table(spark, d, "lineitem", "l_returnflag", "l_partkey").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"))


@query("A4_collect_sorted_capped", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment))[1:3], ';') AS segments FROM customer GROUP BY 1")
def a4(spark, d):
    return table(spark, d, "customer", "c_nationkey", "c_mktsegment").groupBy("c_nationkey").agg(F.array_join(F.slice(F.sort_array(F.collect_set("c_mktsegment")), 1, 3), ";").alias("segments"))


@query("A5_summary_statistics", """SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS lo, max(l_quantity) AS hi,
  quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1""")
def a5(spark, d):
    q = F.percentile("l_quantity", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = table(spark, d, "lineitem", "l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.count("l_quantity").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), q.alias("q"))
    return out.select("*", *[F.col("q")[k].alias(c) for k, c in enumerate(("p10", "p50", "p90"))]).drop("q")


@query("A6_pivot_drop_incomplete", """SELECT l_suppkey, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS "A", round(avg(l_discount) FILTER (l_returnflag = 'N'), 6) AS "N", round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS "R"
  FROM lineitem GROUP BY 1 HAVING "A" IS NOT NULL AND "N" IS NOT NULL AND "R" IS NOT NULL""")
def a6(spark, d):
    return table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_discount").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_discount"), 6)).na.drop(subset=["A", "N", "R"])


@query("A7_conditional_rates", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END), 8) AS high, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS mean_open
  FROM orders GROUP BY 1""")
def a7(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.round(F.avg((F.col("o_totalprice") > 100000).cast("double")), 8).alias("high"), F.round(F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 4).alias("mean_open"))


@query("A8_macro_average", "SELECT l_linestatus, round(avg(m), 6) AS macro FROM (SELECT l_linestatus, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY 1")
def a8(spark, d):
    per = table(spark, d, "lineitem", "l_linestatus", "l_returnflag", "l_quantity").groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_quantity").alias("m"))
    return per.groupBy("l_linestatus").agg(F.round(F.avg("m"), 6).alias("macro"))


@query("A9_micro_f1", f"""WITH {TOKENS}, s AS (SELECT case_id, list(value) FILTER (code <> 'E_1') AS gold, list(value) FILTER (code <> 'E_2') AS pred FROM tokens GROUP BY 1),
  c AS (SELECT case_id % 10 AS fold, len(list_intersect(gold, pred)) AS tp, len(pred) AS np, len(gold) AS ng FROM s)
  SELECT fold, sum(tp)::BIGINT AS tp, round(sum(tp) / sum(np), 8) AS "precision", round(sum(tp) / sum(ng), 8) AS recall, round(2.0 * sum(tp) / (sum(np) + sum(ng)), 8) AS f1 FROM c GROUP BY 1""")
def a9(spark, d):
    s = tokens(spark, d).groupBy("case_id").agg(F.collect_list(F.when(F.col("code") != "E_1", F.col("value"))).alias("gold"), F.collect_list(F.when(F.col("code") != "E_2", F.col("value"))).alias("pred"))
    c = s.select((F.col("case_id") % 10).alias("fold"), F.size(F.array_intersect("gold", "pred")).alias("tp"), F.size("pred").alias("np"), F.size("gold").alias("ng"))
    tp, n_p, n_g = F.sum("tp"), F.sum("np"), F.sum("ng")
    return c.groupBy("fold").agg(tp.alias("tp"), F.round(tp / n_p, 8).alias("precision"), F.round(tp / n_g, 8).alias("recall"), F.round(2 * tp / (n_p + n_g), 8).alias("f1"))


@query("A10_exact_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def a10(spark, d):
    return table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("A11_quartiles_with_minimum", """SELECT user_id, count(value) AS n, CASE WHEN count(value) >= 60 THEN round(quantile_cont(value, 0.25), 6) END AS q1, CASE WHEN count(value) >= 60 THEN round(quantile_cont(value, 0.5), 6) END AS q2,
  CASE WHEN count(value) >= 60 THEN round(quantile_cont(value, 0.75), 6) END AS q3 FROM events GROUP BY 1""")
def a11(spark, d):
    out = A.quartiles(table(spark, d, "events", "user_id", "value"), "value", ["user_id"], least=60)
    return out.select("user_id", "n", *[F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")])


@query("A12_median_label", "SELECT user_id, CASE WHEN median(value) < 9.5 THEN 'EARLY' WHEN median(value) < 10.5 THEN 'MIDDLE' ELSE 'LATE' END AS label FROM events GROUP BY 1")
def a12(spark, d):
    m = F.median("value")
    return table(spark, d, "events", "user_id", "value").groupBy("user_id").agg(F.when(m < 9.5, "EARLY").when(m < 10.5, "MIDDLE").otherwise("LATE").alias("label"))


@query("A13_threshold_at_fpr", "SELECT round(quantile_cont(o_totalprice, 0.95), 4) AS t05, round(quantile_cont(o_totalprice, 0.99), 4) AS t01 FROM orders WHERE o_orderstatus <> 'F'")
def a13(spark, d):
    return table(spark, d, "orders", "o_totalprice", "o_orderstatus").where("o_orderstatus <> 'F'").agg(F.round(F.percentile("o_totalprice", 0.95), 4).alias("t05"), F.round(F.percentile("o_totalprice", 0.99), 4).alias("t01"))


@query("A14_cooccurrence_counts", f"""WITH {TOKENS}, {CASES}, s AS (SELECT * FROM (SELECT DISTINCT label FROM cases) CROSS JOIN (SELECT DISTINCT code, value FROM tokens))
  SELECT s.label, s.code, s.value, count(t.case_id) AS n FROM s LEFT JOIN (SELECT label, code, value, case_id FROM tokens JOIN cases USING (case_id)) t ON s.label = t.label AND s.code = t.code AND s.value = t.value GROUP BY ALL""")
def a14(spark, d):
    t, c = tokens(spark, d), cases(spark, d).select("case_id", "label")
    n = t.join(c, "case_id").groupBy("label", "code", "value").agg(F.count("*").alias("n"))
    space = n.select("code", "value").distinct().crossJoin(F.broadcast(c.select("label").distinct()))  # answers x labels: dimensions
    return space.join(n, ["label", "code", "value"], "left").na.fill(0, ["n"])


@query("A15_smoothed_likelihood", f"WITH {LIKELIHOOD} SELECT code, value, label, round(p, 10) AS p FROM likelihood")
def a15(spark, d):
    return likelihood(spark, d).withColumn("p", F.round("p", 10))


@query("A16_complement_counts", f"""WITH {TOKENS}, {CASES} SELECT c.label, q.code, count(*) AS n, count(h.case_id) AS n_has, greatest(count(*) - count(h.case_id), 0) AS n_neg
  FROM cases c CROSS JOIN (SELECT DISTINCT code FROM tokens) q LEFT JOIN (SELECT DISTINCT case_id, code FROM tokens WHERE value IN ('A', 'O', 'V_1')) h ON c.case_id = h.case_id AND q.code = h.code GROUP BY ALL""")
def a16(spark, d):
    c, t = cases(spark, d).select("case_id", "label"), tokens(spark, d)
    total = c.groupBy("label").agg(F.count("*").alias("n"))
    has = t.where(F.col("value").isin("A", "O", "V_1")).select("case_id", "code").distinct().join(c, "case_id").groupBy("label", "code").agg(F.count("*").alias("n_has"))
    space = t.select("code").distinct().crossJoin(F.broadcast(total))  # codes x labels: dimensions
    return space.join(has, ["label", "code"], "left").na.fill(0, ["n_has"]).withColumn("n_neg", F.greatest(F.col("n") - F.col("n_has"), F.lit(0)))


@query("A17_weighted_sum_by_segment", "SELECT l_suppkey, round(sum(l_quantity * l_discount), 4) AS w FROM lineitem GROUP BY 1")
def a17(spark, d):
    return table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_discount").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("w"))


@query("A18_first_eligible", "SELECT user_id, event_type, min(ts) AS first_at, min_by(event_id, ts) AS event_id FROM events WHERE value > 5 GROUP BY ALL")
def a18(spark, d):
    return table(spark, d, "events", "user_id", "event_type", "ts", "event_id", "value").where("value > 5").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_at"), F.min_by("event_id", "ts").alias("event_id"))


@query("A19_null_safe_group_key", "SELECT nullif(o_orderstatus, 'P') AS status, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def a19(spark, d):
    return table(spark, d, "orders", "o_orderstatus", "o_orderpriority").groupBy(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_orderpriority").agg(F.count("*").alias("n"))


@query("A20_calibration_error", """WITH b AS (SELECT o_orderpriority AS k, greatest(ceil(conf * 15), 1) AS bin, count(*) AS n, sum(conf) AS c, sum(ok) AS ok FROM
    (SELECT o_orderpriority, (o_orderkey % 100) / 99.0 AS conf, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS ok FROM orders) GROUP BY ALL)
  SELECT k, round(sum(abs(c - ok)) / sum(n), 8) AS ece FROM b GROUP BY 1""")
def a20(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), ((F.col("o_orderkey") % 100) / 99.0).alias("conf"), (F.col("o_orderstatus") == "F").alias("ok"))
    return A.binned_calibration_error(o, "conf", "ok", ["k"]).withColumn("ece", F.round("ece", 8))


@query("A21_brier_score", f"""WITH {LIKELIHOOD}, s AS (SELECT case_id, label, exp(ll) / sum(exp(ll)) OVER (PARTITION BY case_id) AS p FROM
    (SELECT t.case_id, l.label, sum(ln(p)) AS ll FROM tokens t JOIN likelihood l USING (code, value) GROUP BY ALL))
  SELECT case_id, round(sum(power(s.p - CASE WHEN s.label = c.label THEN 1 ELSE 0 END, 2)), 8) AS brier FROM s JOIN (SELECT case_id, label FROM cases) c USING (case_id) GROUP BY 1""")
def a21(spark, d):
    from ..operators.simulation import case_posteriors

    p = case_posteriors(evidence(spark, d), likelihood(spark, d), "case_id", ["code", "value"], "label", once=True)
    c = cases(spark, d).select("case_id", F.col("label").alias("truth"))
    hit = lambda x: x["p"] - (x["label"] == F.col("truth")).cast("int")
    return p.join(c, "case_id").select("case_id", F.round(F.aggregate("post", F.lit(0.0), lambda acc, x: acc + hit(x) * hit(x)), 8).alias("brier"))
