"""Queries W1 to W18."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as W
from ..registry import query
from .fixtures import OBSERVATIONS, STAYS, observations, stays, table


@query("W1_first_row_then_class", f"WITH {STAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY intime, stay_id) AS k FROM stays) SELECT user_id, stay_id FROM r WHERE k = 1 AND stay_id % 2 = 0")
def w1(spark, d):
    # The class is tested after the first row is taken: a later row does not replace it.
    return W.first_row(stays(spark, d), ["user_id"], ["intime", "stay_id"]).where("stay_id % 2 = 0").select("user_id", "stay_id")


@query("W2_latest_view", f"""WITH {OBSERVATIONS} SELECT patient, node, obs_id, status FROM obs WHERE recorded_at <= TIMESTAMP '2024-01-20'
  QUALIFY row_number() OVER (PARTITION BY patient, node ORDER BY recorded_at DESC, observed_at DESC, obs_id DESC) = 1""")
def w2(spark, d):
    known = observations(spark, d).where("recorded_at <= timestamp_ntz'2024-01-20'")
    best = known.groupBy("patient", "node").agg(F.max_by(F.struct("obs_id", "status"), F.struct("recorded_at", "observed_at", "obs_id")).alias("b"))
    return best.select("patient", "node", "b.obs_id", "b.status")


@query("W3_running_group", "SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM events")
def w3(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    return W.running_group(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "user_id", "group_no")


@query("W4_previous_known_change", f"""WITH {OBSERVATIONS}, p AS (SELECT obs_id, status, last_value(CASE WHEN status NOT IN ('UNCERTAIN', 'NOT_RECORDED') THEN status END IGNORE NULLS)
    OVER (PARTITION BY patient, node ORDER BY observed_at, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM obs)
  SELECT obs_id, previous, CASE WHEN status IN ('UNCERTAIN', 'NOT_RECORDED') THEN 'UNKNOWN' WHEN previous IS NULL THEN 'NEW' WHEN previous = status THEN 'SAME' ELSE 'CHANGED' END AS change FROM p""")
def w4(spark, d):
    known = ~F.col("status").isin("UNCERTAIN", "NOT_RECORDED")
    p = W.previous_known(observations(spark, d), ["patient", "node"], ["observed_at", "obs_id"], known, F.col("status"))
    change = F.when(~known, "UNKNOWN").when(F.col("previous").isNull(), "NEW").when(F.col("previous") == F.col("status"), "SAME").otherwise("CHANGED")
    return p.select("obs_id", "previous", change.alias("change"))


@query("W5_episodes", f"""WITH {OBSERVATIONS}, k AS (SELECT patient, node, observed_at, status = 'POSITIVE' AS o, status = 'NEGATIVE' AS c FROM obs WHERE status IN ('POSITIVE', 'NEGATIVE')),
  l AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY patient, node ORDER BY observed_at), false) AS was FROM k),
  g AS (SELECT *, CAST(sum(CASE WHEN o AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY patient, node ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM l WHERE o OR was)
  SELECT patient, node, episode, min(observed_at) AS started, max(observed_at) FILTER (c) AS ended, count(*) FILTER (o) AS n FROM g GROUP BY ALL""")
def w5(spark, d):
    return W.episodes(observations(spark, d), ["patient", "node"], "observed_at", F.col("status") == "POSITIVE", F.col("status") == "NEGATIVE")


@query("W6_first_against_last", "SELECT user_id, CASE WHEN max_by(value, ts) - min_by(value, ts) > 0.05 THEN 'WORSE' WHEN max_by(value, ts) - min_by(value, ts) < -0.05 THEN 'BETTER' ELSE 'SAME' END AS course FROM events GROUP BY 1")
def w6(spark, d):
    gap = F.max_by("value", "ts") - F.min_by("value", "ts")
    return table(spark, d, "events", "user_id", "value", "ts").groupBy("user_id").agg(F.when(gap > 0.05, "WORSE").when(gap < -0.05, "BETTER").otherwise("SAME").alias("course"))


@query("W7_scale_by_group_max", "SELECT user_id, event_type, round(n / max(n) OVER (PARTITION BY user_id), 8) AS scaled FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def w7(spark, d):
    n = table(spark, d, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.select("user_id", "event_type", F.round(F.col("n") / F.max("n").over(Window.partitionBy("user_id")), 8).alias("scaled"))


@query("W8_pessimistic_rank", "SELECT p_partkey, rank() OVER w + count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS rank FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)")
def w8(spark, d):
    return W.pessimistic_rank(table(spark, d, "part", "p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]).select("p_partkey", "rank")


@query("W9_average_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part")
def w9(spark, d):
    return W.average_rank(table(spark, d, "part", "p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]).select("p_partkey", "rank")


@query("W10_empirical_cdf", """WITH t AS (SELECT l_returnflag AS k, l_quantity AS v FROM lineitem WHERE l_orderkey % 5 <> 0), n AS (SELECT k, v, count(*) AS n FROM t GROUP BY ALL),
  x AS (SELECT DISTINCT l_returnflag AS k, l_quantity AS v FROM lineitem WHERE l_orderkey % 5 = 0)
  SELECT x.k, x.v, round((coalesce(sum(n) FILTER (n.v < x.v), 0) + coalesce(sum(n) FILTER (n.v = x.v), 0) / 2.0) / sum(n), 8) AS percentile FROM x JOIN n ON x.k = n.k GROUP BY ALL""")
def w10(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity").select("l_orderkey", F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("v"))
    test = li.where("l_orderkey % 5 = 0").select("k", "v").distinct()
    return W.empirical_cdf(li.where("l_orderkey % 5 <> 0"), test, "v", ["k"]).withColumn("percentile", F.round("percentile", 8))


@query("W11_round_robin_folds", "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_custkey AS VARCHAR)), CAST(c_custkey AS VARCHAR)) - 1) % 5 AS INT) AS fold FROM customer")
def w11(spark, d):
    return W.round_robin_folds(table(spark, d, "customer", "c_custkey", "c_mktsegment"), "c_mktsegment", F.col("c_custkey").cast("string"), 5).select("c_custkey", "fold")


@query("W12_quartile_by_cuts", """WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS c FROM orders)
  SELECT o_orderkey, CAST(1 + len(list_filter(c, lambda x: x <= o_totalprice)) AS INT) AS quartile FROM orders CROSS JOIN q""")
def w12(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    cuts = o.agg(F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("cuts"))
    return o.crossJoin(F.broadcast(cuts)).select("o_orderkey", A.cuts_at_or_below(F.col("o_totalprice"), F.col("cuts")).alias("quartile"))  # one row


@query("W13_non_overlapping_spans", """WITH RECURSIVE s AS (SELECT o_custkey AS k, o_orderkey % 97 AS a, o_orderkey % 97 + 1 + o_orderkey % 13 AS b FROM orders WHERE o_custkey < 200),
  r AS (SELECT k, min(a) AS a, max_by(b, -1000 * a + b) AS b FROM s GROUP BY 1
    UNION ALL SELECT s.k, min(s.a), max_by(s.b, -1000 * s.a + s.b) FROM s JOIN r ON s.k = r.k AND s.a >= r.b GROUP BY s.k, r.a)
  SELECT k, string_agg(a || '-' || b, ',' ORDER BY a) AS chosen FROM r GROUP BY 1""")
def w13(spark, d, keep="o_custkey < 200"):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").where(keep)
    s = o.select(F.col("o_custkey").alias("k"), F.struct((F.col("o_orderkey") % 97).alias("start"), (F.col("o_orderkey") % 97 + 1 + F.col("o_orderkey") % 13).alias("end")).alias("s"))
    chosen = W.non_overlapping(F.collect_list("s"))
    return s.groupBy("k").agg(F.array_join(F.transform(chosen, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("chosen"))


@query("W14_inherited_back", """WITH e AS (SELECT user_id, ts, CASE WHEN event_type <> 'view' THEN event_type END AS label FROM events WHERE event_id < 5000)
  SELECT user_id, string_agg(coalesce(l, '?'), ',' ORDER BY ts) AS labels FROM (SELECT user_id, ts, first_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM e) GROUP BY 1""")
def w14(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_id < 5000")
    rows = F.sort_array(F.collect_list(F.struct("ts", F.when(F.col("event_type") != "view", F.col("event_type")).alias("label"))))
    labels = e.groupBy("user_id").agg(F.transform(rows, lambda x: x["label"]).alias("labels"))
    return labels.select("user_id", F.array_join(W.inherited_back(F.col("labels")), ",", "?").alias("labels"))


@query("W15_carried_forward", "SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_by FROM conversations")
def w15(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "role").withColumn("who", F.when(F.col("role") != "assistant", F.col("role")))
    return W.carried_forward(c, ["conv_id"], ["turn"], "who", "asked_by").select("conv_id", "turn", "asked_by")


@query("W16_adjacent_propagation", """WITH RECURSIVE b AS (SELECT event_id, user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
  r AS (SELECT event_id, user_id, k, CASE WHEN event_type = 'signup' THEN event_id END AS onset FROM b WHERE k = 1
    UNION ALL SELECT b.event_id, b.user_id, b.k, CASE WHEN b.event_type = 'signup' THEN b.event_id WHEN b.event_type = 'error' THEN NULL ELSE r.onset END FROM b JOIN r ON b.user_id = r.user_id AND b.k = r.k + 1)
  SELECT event_id, onset FROM r""")
def w16(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    # A signup sets the onset, an error clears it; all else carries it: the last of either decides.
    setting = F.when(F.col("event_type") == "signup", F.struct(F.col("event_id").alias("v"))).when(F.col("event_type") == "error", F.struct(F.lit(None).cast("long").alias("v")))
    last = F.last(setting, ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", last["v"].alias("onset"))


@query("W17_transitions", f"""WITH {OBSERVATIONS}, v AS (SELECT t, patient, node, max_by(status, obs_id) AS status FROM obs JOIN (VALUES (1, TIMESTAMP '2024-01-10'), (2, TIMESTAMP '2024-01-20')) k(t, until) ON recorded_at <= until GROUP BY ALL)
  SELECT coalesce(a.patient, b.patient) AS patient, coalesce(a.node, b.node) AS node, a.status AS "before", b.status AS "after" FROM (SELECT * FROM v WHERE t = 1) a FULL JOIN (SELECT * FROM v WHERE t = 2) b
  ON a.patient = b.patient AND a.node = b.node WHERE a.status IS DISTINCT FROM b.status""")
def w17(spark, d):
    o = observations(spark, d)
    at = lambda day, name: F.max_by(F.when(F.expr(f"recorded_at <= timestamp_ntz'{day}'"), F.col("status")), F.when(F.expr(f"recorded_at <= timestamp_ntz'{day}'"), F.col("obs_id"))).alias(name)
    # Both snapshots come from one pass over the observations.
    both = o.groupBy("patient", "node").agg(at("2024-01-10", "before"), at("2024-01-20", "after"))
    return both.where(~F.equal_null("before", "after"))


@query("W18_first_step_in_top", "SELECT l_orderkey, min(l_linenumber) FILTER (l_quantity >= 40) AS step FROM lineitem GROUP BY 1")
def w18(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey").agg(F.min(F.when(F.col("l_quantity") >= 40, F.col("l_linenumber"))).alias("step"))
