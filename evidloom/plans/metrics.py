"""Queries A22 to A43: ranking quality, intervals, multiple testing, suppression, digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.windows import average_rank
from ..registry import query
from .fixtures import table, tokens, TOKENS

#: A score with many ties, a class and a fold for each order.
SCORED = "scored AS (SELECT o_orderkey AS id, o_custkey % 37 AS score, o_orderstatus = 'F' AS pos, CAST(o_orderkey % 5 AS INT) AS fold FROM orders WHERE NOT (o_orderkey % 5 = 4 AND o_orderstatus = 'F'))"


def scored(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").where("not (o_orderkey % 5 = 4 and o_orderstatus = 'F')")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 37).alias("score"), (F.col("o_orderstatus") == "F").alias("pos"), (F.col("o_orderkey") % 5).cast("int").alias("fold"))


AUROC = """f AS (SELECT fold, CASE WHEN count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0 THEN (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) END AS auroc,
    count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg
  FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r FROM scored) GROUP BY 1)"""


@query("A22_auroc", f"WITH {SCORED}, {AUROC} SELECT fold, round(auroc, 8) AS auroc, n_pos, n_neg FROM f")
def a22(spark, d):
    return A.auroc(scored(spark, d), "score", "pos", ["fold"]).withColumn("auroc", F.round("auroc", 8))


@query("A23_fold_mean_auroc", f"WITH {SCORED}, {AUROC} SELECT round(avg(auroc), 8) AS mean_auroc, count(auroc) AS folds FROM f")
def a23(spark, d):
    return A.auroc(scored(spark, d), "score", "pos", ["fold"]).agg(F.round(F.avg("auroc"), 8).alias("mean_auroc"), F.count("auroc").alias("folds"))


@query("A24_average_precision", f"""WITH {SCORED}, e AS (SELECT fold, score, count(*) FILTER (pos) AS p, count(*) AS n FROM scored GROUP BY ALL),
  c AS (SELECT fold, p, sum(p) OVER w / sum(n) OVER w AS prec FROM e WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
  SELECT fold, round(CASE WHEN sum(p) > 0 THEN sum(p * prec) / sum(p) END, 8) AS ap FROM c GROUP BY 1""")
def a24(spark, d):
    return A.average_precision(scored(spark, d), "score", "pos", ["fold"]).withColumn("ap", F.round("ap", 8))


@query("A25_wilson_interval", """SELECT o_custkey, k, n, round((k / n + 1.959963984540054 * 1.959963984540054 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n))) / (1 + 1.959963984540054 * 1.959963984540054 / n), 8) AS lo,
    round((k / n + 1.959963984540054 * 1.959963984540054 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n))) / (1 + 1.959963984540054 * 1.959963984540054 / n), 8) AS hi
  FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY 1)""")
def a25(spark, d):
    c = table(spark, d, "orders", "o_custkey", "o_orderstatus").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    lo, hi = A.wilson(F.col("k"), F.col("n"))
    return c.select("o_custkey", "k", "n", F.round(lo, 8).alias("lo"), F.round(hi, 8).alias("hi"))


@query("A26_entropy_margin", """SELECT l_suppkey, round(e, 8) AS entropy, round(t, 8) AS top, round(t - coalesce(ps[2], 0), 8) AS margin FROM (SELECT l_suppkey, -sum(p * ln(p + 1e-12)) AS e, max(p) AS t, list_reverse_sort(list(p)) AS ps FROM
  (SELECT l_suppkey, l_returnflag, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey) AS p FROM lineitem GROUP BY l_suppkey, l_returnflag) GROUP BY 1)""")
def a26(spark, d):
    n = table(spark, d, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    p = n.select("l_suppkey", (F.col("n") / F.sum("n").over(Window.partitionBy("l_suppkey"))).alias("p"))
    top = F.sort_array(F.collect_list("p"), asc=False)
    return p.groupBy("l_suppkey").agg(F.round(-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12)), 8).alias("entropy"), F.round(F.max("p"), 8).alias("top"), F.round(F.max("p") - F.coalesce(F.get(top, F.lit(1)), F.lit(0)), 8).alias("margin"))


@query("A27_correlations", """SELECT fold, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY x) + (count(*) OVER (PARTITION BY fold, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY fold ORDER BY y) + (count(*) OVER (PARTITION BY fold, y) - 1) / 2.0 AS ry FROM (SELECT l_returnflag || l_linestatus AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem)) GROUP BY 1""")
def a27(spark, d):
    r = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("fold"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    r = average_rank(average_rank(r, "x", ["fold"], "rx"), "y", ["fold"], "ry")
    return r.groupBy("fold").agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))


@query("A28_clustered_bootstrap")
def a28(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_totalprice")
    b = A.hash_bootstrap(o, "o_custkey", "o_totalprice", replicates=200, seed=11)
    return b.agg(F.percentile("estimate", 0.025).alias("lo"), F.percentile("estimate", 0.975).alias("hi"), F.count("*").alias("replicates"))


@query("A29_stratified_bootstrap")
def a29(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    b = A.stratified_bootstrap(o, "o_orderpriority", "o_orderkey", "o_totalprice", replicates=100, seed=13)
    return b.agg(F.percentile("estimate", 0.025).alias("lo"), F.percentile("estimate", 0.975).alias("hi"))


@query("A30_one_sided_p", """WITH b AS (SELECT o_orderpriority AS k, (count(*) FILTER (o_totalprice <= 60000) + 1.0) / (count(*) + 1) AS p FROM orders GROUP BY 1)
  SELECT k, round(p, 10) AS p, round(max(p) OVER (), 10) AS composite FROM b""")
def a30(spark, d):
    b = table(spark, d, "orders", "o_orderpriority", "o_totalprice").groupBy(F.col("o_orderpriority").alias("k")).agg(((F.count_if(F.col("o_totalprice") <= 60000) + 1) / (F.count("*") + 1)).alias("p"))
    worst = b.agg(F.coalesce(F.max("p"), F.lit(1.0)).alias("composite"))
    return b.crossJoin(F.broadcast(worst)).select("k", F.round("p", 10).alias("p"), F.round("composite", 10).alias("composite"))


@query("A31_holm", """WITH p AS (SELECT l_linestatus AS family, l_suppkey AS h, count(*) FILTER (l_discount > 0.095) / (8.0 * count(*)) AS p FROM lineitem GROUP BY ALL),
  r AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY family) - rank() OVER (PARTITION BY family ORDER BY p) + 1)) AS raw FROM p),
  a AS (SELECT family, h, p, max(raw) OVER (PARTITION BY family ORDER BY p RANGE UNBOUNDED PRECEDING) AS adj FROM r)
  SELECT family, h, round(p, 10) AS p, round(adj, 8) AS p_adjusted, adj <= 0.05 AS rejected FROM a""")
def a31(spark, d):
    p = table(spark, d, "lineitem", "l_linestatus", "l_suppkey", "l_discount").groupBy(F.col("l_linestatus").alias("family"), F.col("l_suppkey").alias("h")).agg((F.count_if(F.col("l_discount") > 0.095) / (8.0 * F.count("*"))).alias("p"))
    return A.holm(p, "p", ["family"]).select("family", "h", F.round("p", 10).alias("p"), F.round("p_adjusted", 8).alias("p_adjusted"), "rejected")


@query("A32_z_scores", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_type)) / stddev_pop(p_retailprice) OVER (PARTITION BY p_type), 6) AS z FROM part")
def a32(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_type", "p_retailprice")
    # Moments by partial aggregation, joined back: a hot type is not gathered in one window.
    m = p.groupBy("p_type").agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"))
    return p.join(m, "p_type").select("p_partkey", F.round((F.col("p_retailprice") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("A34_small_cell_suppression", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS total FROM c GROUP BY 1)
  SELECT user_id, event_type, CASE WHEN n < 10 THEN '<10' WHEN n < 100 THEN '10-99' WHEN n < 1000 THEN '100-999' ELSE '>=1000' END AS bucket, CAST(least(floor(10 * n / total), 9) AS BIGINT) AS share FROM c JOIN t USING (user_id)""")
def a34(spark, d):
    c = table(spark, d, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return c.select("user_id", "event_type", A.suppressed(F.col("n")).alias("bucket"), A.share_bin(F.col("n"), total).alias("share"))


@query("A35_confusion_pairs_top", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 4")
def a35(spark, d):
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_returnflag", "l_linestatus").limit(4)


@query("A36_duplicate_rows", "SELECT count(*) AS n, count(*) - count(DISTINCT sha256(coalesce(text, ''))) AS n_duplicate FROM documents")
def a36(spark, d):
    h = table(spark, d, "documents", "text").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.count("*").alias("n"))
    return h.agg(F.sum("n").alias("n"), (F.sum("n") - F.count("*")).alias("n_duplicate"))


@query("A37_cross_split_overlap", """WITH s AS (SELECT DISTINCT doc_id % 3 AS split, sha256(text) AS h FROM documents WHERE text IS NOT NULL)
  SELECT a.split AS a, b.split AS b, count(*) AS n FROM s a JOIN s b ON a.h = b.h AND a.split < b.split GROUP BY ALL""")
def a37(spark, d):
    s = table(spark, d, "documents", "doc_id", "text").where("text is not null").select((F.col("doc_id") % 3).alias("split"), F.sha2("text", 256).alias("h"))
    # At most three splits meet in a fingerprint, so the pairs come from its set.
    sets = s.groupBy("h").agg(F.sort_array(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("A39_threshold_ladder", """SELECT l_returnflag AS mode, t AS threshold, count(*) FILTER (n >= t) AS n_reached FROM (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) CROSS JOIN (VALUES (1), (2), (3), (5), (20)) v(t) GROUP BY ALL""")
def a39(spark, d):
    n = table(spark, d, "lineitem", "l_returnflag", "l_partkey").groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("n"))
    ladder = (1, 2, 3, 5, 20)
    counts = n.groupBy(F.col("l_returnflag").alias("mode")).agg(F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("n") >= t).alias("n_reached")) for t in ladder]).alias("x"))
    return counts.select("mode", F.inline("x"))


@query("A40_integer_decisions", """WITH c AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k, count(*) FILTER (l_returnflag = 'A') AS k_old FROM lineitem GROUP BY 1)
  SELECT l_suppkey, (k - k_old) * 100 >= n AS better, k * 50 > n AS enough, (n - k) * 1000 < n AS few FROM c""")
def a40(spark, d):
    c = table(spark, d, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count_if(F.col("l_returnflag") == "A").alias("k_old"))
    return c.selectExpr("l_suppkey", "(k - k_old) * 100 >= n as better", "k * 50 > n as enough", "(n - k) * 1000 < n as few")


@query("A41_validation_counters", "SELECT count(*) AS n, count(*) FILTER (l_quantity < 2) AS low, count(*) FILTER (l_discount > 0.09) AS discount, count(*) FILTER (l_shipdate < TIMESTAMP '1996-01-01') AS early, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS flag FROM lineitem")
def a41(spark, d):
    rules = {"low": F.col("l_quantity") < 2, "discount": F.col("l_discount") > 0.09, "early": F.expr("l_shipdate < timestamp_ntz'1996-01-01'"), "flag": ~F.col("l_returnflag").isin("A", "N")}
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in rules.items()])


@query("A42_ordered_text_block", "SELECT conv_id, string_agg(turn || ':' || role, chr(10) ORDER BY turn) AS block FROM conversations GROUP BY 1")
def a42(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "role")
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", F.col("turn").cast("string"), "role").alias("line"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))


@query("A43_id_set_digest", "SELECT o_orderpriority, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS digest FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1")
def a43(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority").where("o_orderkey % 10 = 0")
    return o.groupBy("o_orderpriority").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ","), 256).alias("digest"))
