"""Queries C1 to C24: compound operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graphs as G
from ..operators import topk as T
from ..operators.windows import micros
from ..registry import query
from .fixtures import CASES, OBSERVATIONS, ONTOLOGY, TOKENS, cases, observations, ontology, table, tokens


@query("C1_cohort_selection", """SELECT o_orderkey, o_orderpriority FROM orders WHERE CAST(('0x' || substr(sha256('split|' || o_orderkey), 1, 8)) AS BIGINT) % 10 NOT IN (0, 1) AND o_orderkey % 13 <> 0
  QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('split|' || o_orderkey)) <= 20""")
def c1(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    key = F.concat_ws("|", F.lit("split"), F.col("o_orderkey").cast("string"))
    dev = o.where("o_orderkey % 13 = 0").select("o_orderkey")
    pool = o.where(~(S.hash_number(F.lit("split"), F.col("o_orderkey").cast("string")) % 10).isin(0, 1)).join(dev, "o_orderkey", "left_anti")
    return T.top_k(pool, ["o_orderpriority"], [F.sha2(key, 256)], 20)


@query("C2_rank_pair", "SELECT p_partkey, rank() OVER w + count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS pessimistic, rank() OVER w AS optimistic FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)")
def c2(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"))
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    return p.select("p_partkey", F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("pessimistic"), F.rank().over(w).cast("long").alias("optimistic"))


@query("C3_edge_ablation", f"WITH {ONTOLOGY} SELECT m.drop_class, count(*) AS n FROM isa CROSS JOIN (VALUES (0), (1), (2)) m(drop_class) WHERE child % 3 <> m.drop_class GROUP BY ALL")
def c3(spark, d):
    e = ontology(spark, d)
    kept = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda x: F.col("child") % 3 != x)
    return e.select(F.explode(kept).alias("drop_class")).groupBy("drop_class").agg(F.count("*").alias("n"))


@query("C4_unreachable_share", f"""WITH RECURSIVE {ONTOLOGY}, up AS (SELECT child AS node, parent AS anc FROM isa WHERE child % 10 = 0 UNION SELECT u.node, i.parent FROM up u JOIN isa i ON u.anc = i.child),
  p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey % 10 = 0 AND l_quantity > 40)
  SELECT l_suppkey, round(avg(CASE WHEN h.node IS NULL THEN 1.0 ELSE 0.0 END), 8) AS gap FROM p LEFT JOIN (SELECT DISTINCT node FROM up WHERE anc = 7) h ON p.l_partkey = h.node GROUP BY 1""")
def c4(spark, d, keep="l_partkey % 10 = 0"):
    hit = G.closure(ontology(spark, d), "parent", "child", spark.createDataFrame([(7,)], "parent long")).select(F.col("ancestor").alias("l_partkey"), F.lit(0.0).alias("miss"))
    p = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").where(f"{keep} and l_quantity > 40").select("l_suppkey", "l_partkey").distinct()
    return p.join(hit, "l_partkey", "left").groupBy("l_suppkey").agg(F.round(F.avg(F.coalesce("miss", F.lit(1.0))), 8).alias("gap"))


@query("C5_failure_cause", f"""WITH {OBSERVATIONS} SELECT patient, CASE WHEN bool_or(node = 'error' AND status = 'POSITIVE') THEN 'CONFLICT' WHEN NOT bool_or(status = 'POSITIVE') THEN 'NO_EVIDENCE' WHEN count(DISTINCT CASE WHEN status = 'POSITIVE' THEN node END) < 3 THEN 'THIN' ELSE 'TIE' END AS cause FROM obs WHERE obs_id % 9 = 0 GROUP BY 1""")
def c5(spark, d, keep="obs_id % 9 = 0"):
    positive = F.col("status") == "POSITIVE"
    g = observations(spark, d).where(keep).groupBy("patient").agg(F.bool_or((F.col("node") == "error") & positive).alias("c"), F.bool_or(positive).alias("some"), F.count_distinct(F.when(positive, F.col("node"))).alias("n"))
    return g.select("patient", F.when(F.col("c"), "CONFLICT").when(~F.col("some"), "NO_EVIDENCE").when(F.col("n") < 3, "THIN").otherwise("TIE").alias("cause"))


@query("C6_match_classes", """WITH p AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name || ' ' || p_type, ' '))) AS t, p_size FROM part WHERE p_partkey < 200), f AS (SELECT s_suppkey, ['red', 'gear', 'PROMO', 'old'] AS t, s_suppkey % 50 AS n FROM supplier WHERE s_suppkey < 10),
  x AS (SELECT p_partkey, s_suppkey, len(list_intersect(p.t, f.t)) / least(len(p.t), len(f.t)) AS r, p_size % 50 = n AS same FROM p CROSS JOIN f)
  SELECT p_partkey, s_suppkey, CASE WHEN r >= 0.66 AND same THEN 'EXACT' WHEN r >= 0.66 THEN 'ATTRIBUTE_DIFFERS' WHEN r > 0 THEN 'PARTIAL' ELSE 'NONE' END AS class FROM x""")
def c6(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size").where("p_partkey < 200").select("p_partkey", "p_size", F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("t"))
    f = table(spark, d, "supplier", "s_suppkey").where("s_suppkey < 10").select("s_suppkey", F.array(*map(F.lit, ("red", "gear", "PROMO", "old"))).alias("ft"), (F.col("s_suppkey") % 50).alias("n"))
    r = F.size(F.array_intersect("t", "ft")) / F.least(F.size("t"), F.size("ft"))
    kind = F.when((r >= 0.66) & (F.col("p_size") % 50 == F.col("n")), "EXACT").when(r >= 0.66, "ATTRIBUTE_DIFFERS").when(r > 0, "PARTIAL").otherwise("NONE")
    return p.crossJoin(F.broadcast(f)).select("p_partkey", "s_suppkey", kind.alias("class"))  # ten facts


@query("C7_strict_lenient_coverage", f"""WITH {OBSERVATIONS} SELECT node, CASE WHEN count(*) FILTER (status <> 'NOT_TESTED') = 0 THEN 0.0 ELSE round(count(*) FILTER (status = 'POSITIVE') / count(*) FILTER (status <> 'NOT_TESTED'), 8) END AS strict,
  CASE WHEN count(*) FILTER (status <> 'NOT_TESTED') = 0 THEN 0.0 ELSE round(count(*) FILTER (status IN ('POSITIVE', 'UNCERTAIN')) / count(*) FILTER (status <> 'NOT_TESTED'), 8) END AS lenient FROM obs GROUP BY 1""")
def c7(spark, d):
    n = F.count_if(F.col("status") != "NOT_TESTED")
    share = lambda k: F.round(F.coalesce(F.try_divide(F.count_if(k), n), F.lit(0.0)), 8)
    return observations(spark, d).groupBy("node").agg(share(F.col("status") == "POSITIVE").alias("strict"), share(F.col("status").isin("POSITIVE", "UNCERTAIN")).alias("lenient"))


@query("C8_observability", f"""WITH {TOKENS}, {CASES}, n AS (SELECT c.case_id, count(DISTINCT CASE WHEN t.value IN ('A', 'O', 'V_0', 'V_1') THEN t.code END) AS n FROM cases c LEFT JOIN tokens t ON c.case_id = t.case_id GROUP BY 1)
  SELECT round(avg(n), 8) AS mean, median(n) AS median, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 8) AS zero_rate FROM n""")
def c8(spark, d):
    hit = tokens(spark, d).where(F.col("value").isin("A", "O", "V_0", "V_1")).groupBy("case_id").agg(F.count_distinct("code").alias("n"))
    n = cases(spark, d).select("case_id").join(hit, "case_id", "left").na.fill(0, ["n"])
    return n.agg(F.round(F.avg("n"), 8).alias("mean"), F.median("n").alias("median"), F.round(F.avg((F.col("n") == 0).cast("double")), 8).alias("zero_rate"))


@query("C9_pair_contrast_priority", """WITH f AS (SELECT n_nationkey AS x, n_regionkey AS r, n_nationkey % 4 AS e FROM nation) SELECT a.x AS a, b.x AS b, a.e AS e, CASE WHEN a.r <> b.r AND a.x % 2 = 0 THEN 0 WHEN a.r <> b.r THEN 1 WHEN a.x % 2 = b.x % 2 THEN 2 END AS priority FROM f a JOIN f b ON a.e = b.e AND a.x < b.x""")
def c9(spark, d):
    f = table(spark, d, "nation").select(F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("r"), (F.col("n_nationkey") % 4).alias("e"))
    a, b = f.select(F.col("x").alias("a"), F.col("r").alias("ra"), "e"), f.select(F.col("x").alias("b"), F.col("r").alias("rb"), "e")
    differ = F.col("ra") != F.col("rb")
    return a.join(b, "e").where("a < b").select("a", "b", "e", F.when(differ & (F.col("a") % 2 == 0), 0).when(differ, 1).when(F.col("a") % 2 == F.col("b") % 2, 2).alias("priority"))


@query("C10_direct_else_partial", """SELECT p_partkey, CASE WHEN d.k IS NOT NULL THEN 'DIRECT' WHEN q.w IS NOT NULL THEN 'PARTIAL' END AS how FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49) d ON p_partkey = d.k
  LEFT JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part WHERE p_size = 50) q ON split_part(p_name, ' ', 2) = q.w""")
def c10(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_size").withColumn("w", F.substring_index("p_name", " ", -1))
    direct = table(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("d")).distinct()
    part = p.where("p_size = 50").select("w", F.lit(True).alias("q")).distinct()
    return p.join(direct, "p_partkey", "left").join(part, "w", "left").select("p_partkey", F.when(F.col("d"), "DIRECT").when(F.col("q"), "PARTIAL").alias("how"))


@query("C11_selector_family", """SELECT o_custkey, arg_min(o_orderkey, sha256('r|' || o_orderkey)) AS random, arg_max(o_orderkey, o_totalprice) AS by_price, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS by_date FROM orders GROUP BY 1""")
def c11(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.sha2(F.concat_ws("|", F.lit("r"), F.col("o_orderkey").cast("string")), 256)).alias("random"), F.max_by("o_orderkey", "o_totalprice").alias("by_price"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("by_date"))


@query("C12_z_score_fusion", """WITH m AS (SELECT p_brand, p_partkey, (p_size - avg(p_size) OVER w) / stddev_pop(p_size) OVER w AS a, (p_retailprice - avg(p_retailprice) OVER w) / stddev_pop(p_retailprice) OVER w AS b FROM part WINDOW w AS (PARTITION BY p_brand))
  SELECT p_brand, p_partkey, round(0.3 * a + 0.7 * b, 6) AS fused FROM m QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(0.3 * a + 0.7 * b, 6) DESC, p_partkey) <= 3""")
def c12(spark, d):
    p = table(spark, d, "part", "p_brand", "p_partkey", "p_size", "p_retailprice")
    m = p.groupBy("p_brand").agg(*[f(c).alias(f"{n}_{c}") for c in ("p_size", "p_retailprice") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")
    fused = p.join(m, "p_brand").select("p_brand", "p_partkey", F.round(0.3 * z("p_size") + 0.7 * z("p_retailprice"), 6).alias("fused"))
    return T.top_k(fused, ["p_brand"], [F.desc("fused"), F.asc("p_partkey")], 3)


@query("C13_interleaved_ranks", """WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part QUALIFY k <= 5), b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part QUALIFY k <= 5),
  u AS (SELECT p_brand, p_partkey, min(p) AS p FROM (SELECT p_brand, p_partkey, 2 * k AS p FROM a UNION ALL SELECT p_brand, p_partkey, 2 * k + 1 FROM b) GROUP BY ALL) SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p) AS k FROM u""")
def c13(spark, d):
    p = table(spark, d, "part", "p_brand", "p_partkey", "p_size", "p_retailprice")
    ranked = lambda *order: p.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(*order))).where("k <= 5")
    out = T.interleaved(ranked("p_size", "p_partkey"), ranked(F.desc("p_retailprice"), "p_partkey"), ["p_brand"], "p_partkey", "k")
    return out.withColumn("k", F.col("k").cast("long"))


@query("C14_smallest_safe_threshold", """WITH v AS (SELECT l_linestatus AS g, round(l_discount, 2) AS t, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS ok FROM lineitem GROUP BY ALL),
  s AS (SELECT g, t, sum(n) OVER w AS n, sum(ok) OVER w AS ok FROM v WINDOW w AS (PARTITION BY g ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT g, min(t) FILTER (n >= 5 AND ok * 1000 >= n * 668) AS t FROM s GROUP BY 1""")
def c14(spark, d):
    v = table(spark, d, "lineitem", "l_linestatus", "l_discount", "l_returnflag").groupBy(F.col("l_linestatus").alias("g"), F.round("l_discount", 2).alias("t")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("ok"))
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = v.select("g", "t", F.sum("n").over(w).alias("n"), F.sum("ok").over(w).alias("ok"))
    return s.groupBy("g").agg(F.min(F.when((F.col("n") >= 5) & (F.col("ok") * 1000 >= F.col("n") * 668), F.col("t"))).alias("t"))


@query("C15_feasible_grid_tie_band", """WITH g AS (SELECT p_type AS k, p_size AS t, count(*) AS n, avg(p_retailprice) AS s FROM part GROUP BY ALL), b AS (SELECT k, max(s) AS best FROM g WHERE n >= 2 GROUP BY 1)
  SELECT g.k, g.t, g.n FROM g JOIN b ON g.k = b.k WHERE n >= 2 AND s >= best * 0.95 QUALIFY row_number() OVER (PARTITION BY g.k ORDER BY n DESC, t) = 1""")
def c15(spark, d):
    g = table(spark, d, "part", "p_type", "p_size", "p_retailprice").groupBy(F.col("p_type").alias("k"), F.col("p_size").alias("t")).agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("s")).where("n >= 2")
    best = g.groupBy("k").agg(F.max("s").alias("best"))
    return T.top_k(g.join(best, "k").where(F.col("s") >= F.col("best") * 0.95), ["k"], [F.desc("n"), F.asc("t")], 1).select("k", "t", "n")


@query("C16_status_rate_matrix", f"""WITH {OBSERVATIONS} SELECT source, node, round(avg(CASE WHEN status = 'POSITIVE' THEN 1.0 ELSE 0.0 END), 8) AS positive, round(avg(CASE WHEN status IN ('NOT_TESTED', 'NOT_RECORDED') THEN 1.0 ELSE 0.0 END), 8) AS missing,
  round(avg(CASE WHEN status = 'UNCERTAIN' THEN 1.0 ELSE 0.0 END), 8) AS unsure FROM obs GROUP BY ALL""")
def c16(spark, d):
    rate = lambda c: F.round(F.avg(c.cast("double")), 8)
    s = F.col("status")
    return observations(spark, d).groupBy("source", "node").agg(rate(s == "POSITIVE").alias("positive"), rate(s.isin("NOT_TESTED", "NOT_RECORDED")).alias("missing"), rate(s == "UNCERTAIN").alias("unsure"))


@query("C17_sequential_admission", """WITH c AS (SELECT p_name, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1), r AS (SELECT p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)
  SELECT p_partkey, CASE WHEN p_size = 0 THEN 'INVALID' WHEN length(r.p_name) < 8 THEN 'SHORT' WHEN kinds > 6 THEN 'CONFLICT' WHEN k > 1 THEN 'DUPLICATE' ELSE 'ADMITTED' END AS verdict FROM r JOIN c ON r.p_name = c.p_name""")
def c17(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size")
    # Conflicts are found before any row is dropped; the first row of a name by key is its first in file order.
    names = p.groupBy("p_name").agg(F.count_distinct("p_type").alias("kinds"), F.min("p_partkey").alias("first"))
    verdict = F.when(F.col("p_size") == 0, "INVALID").when(F.length("p_name") < 8, "SHORT").when(F.col("kinds") > 6, "CONFLICT").when(F.col("p_partkey") > F.col("first"), "DUPLICATE").otherwise("ADMITTED")
    return p.join(names, "p_name").select("p_partkey", verdict.alias("verdict"))


@query("C20_later_absence_resolves", f"""WITH {OBSERVATIONS} SELECT a.obs_id, min(b.observed_at) AS resolved_at FROM obs a JOIN obs b ON a.patient = b.patient AND a.node = b.node AND b.status = 'NEGATIVE' AND b.observed_at > a.observed_at WHERE a.status = 'POSITIVE' GROUP BY 1""")
def c20(spark, d):
    # The next absent mention by one window from the last row back, instead of a join of all later ones; mentions of the same time are not later.
    w = Window.partitionBy("patient", "node").orderBy(-micros("observed_at")).rangeBetween(Window.unboundedPreceding, -1)
    later = F.min(F.when(F.col("status") == "NEGATIVE", F.col("observed_at"))).over(w)
    return observations(spark, d).withColumn("resolved_at", later).where("status = 'POSITIVE' and resolved_at is not null").select("obs_id", "resolved_at")


@query("C22_catalog_search", "SELECT p_partkey, p_name FROM part WHERE (contains(replace(p_name, ' ', ''), 'dbolt') OR contains(replace(p_type || ' ' || p_brand, ' ', ''), 'MOBrand#2')) AND p_partkey NOT IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49.5) ORDER BY p_partkey LIMIT 10")
def c22(spark, d):
    used = table(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 49.5").select(F.col("l_partkey").alias("p_partkey"))
    holds = lambda c, needle: F.contains(F.regexp_replace(c, r"\s+", ""), F.lit(needle))
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand").where(holds("p_name", "dbolt") | holds(F.concat_ws(" ", "p_type", "p_brand"), "MOBrand#2"))
    return p.select("p_partkey", "p_name").join(used, "p_partkey", "left_anti").orderBy("p_partkey").limit(10)


@query("C23_urgent_flags", "SELECT user_id, bool_or(event_type = 'error') AS urgent, max_by(value, ts) >= 14 AS severe FROM events GROUP BY 1")
def c23(spark, d):
    return table(spark, d, "events", "event_id", "user_id", "event_type", "value", "ts").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("urgent"), (F.max_by("value", F.struct("ts", "event_id")) >= 14).alias("severe"))


@query("C24_list_parse", "SELECT p_partkey, array_to_string(list_distinct([split_part(p_name, ' ', 1)]) || CASE WHEN split_part(p_name, ' ', 2) <> split_part(p_name, ' ', 1) THEN [split_part(p_name, ' ', 2)] ELSE [] END || [p_brand], '|') AS items FROM part")
def c24(spark, d):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ;")), F.lit("/ "), F.col("p_brand"), F.lit("\n"), F.col("p_brand"))
    return table(spark, d, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", F.array_join(S.parsed_list(raw), "|").alias("items"))
