"""Queries C25 to C40: record checks, overlapping windows, index percentiles, agreement and subgroup reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reports as R
from ..registry import query
from ..sources import writers
from .fixtures import table
from .sources import folder


@query("C25_missing_attributes", """SELECT * FROM (
  SELECT s_suppkey, 'onset' AS field FROM supplier WHERE nullif(s_suppkey % 4, 0) IS NULL
  UNION ALL SELECT s_suppkey, 'site' FROM supplier WHERE s_nationkey < 12 AND s_acctbal < 0
  UNION ALL SELECT s_suppkey, 'severity' FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 3 = 1)""")
def c25(spark, d):
    s = table(spark, d, "supplier")
    onset = F.nullif(F.col("s_suppkey") % 4, F.lit(0)).cast("string")
    site = F.when(F.col("s_acctbal") >= 0, F.col("s_name"))
    severity = F.when(F.col("s_suppkey") % 3 == 1, F.lit("")).otherwise("mild")
    return R.missing_attribute_questions(s, "s_suppkey", {"onset": (F.lit(True), onset), "site": (F.col("s_nationkey") < 12, site), "severity": (F.col("s_nationkey") % 2 == 0, severity)})


@query("C26_import_validation", """WITH r AS (SELECT user_id, 'events' || CASE WHEN user_id % 11 = 0 THEN '-old' ELSE '' END AS form, CASE WHEN user_id % 13 = 0 THEN 2 ELSE 1 END AS version,
    CASE WHEN event_id % 997 = 5 THEN substr(props, 2) ELSE props END AS p FROM events),
  g AS (SELECT user_id, bool_and(form = 'events') AS f, bool_and(version = 1) AS v, bool_and(json_valid(p) AND TRY_CAST(TRY_CAST(p AS JSON) ->> 'k' AS INT) IS NOT NULL) AS ok, count(*) AS n FROM r GROUP BY 1)
  SELECT user_id, CASE WHEN NOT f THEN 'WRONG_FORMAT' WHEN NOT v THEN 'WRONG_VERSION' WHEN NOT ok THEN 'INVALID_RECORD' ELSE 'IMPORTED' END AS verdict, CASE WHEN f AND v AND ok THEN n ELSE 0 END AS n_imported FROM g""")
def c26(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "props")
    text = F.when(F.col("event_id") % 997 == 5, F.substring("props", 2, 1 << 20)).otherwise(F.col("props"))
    form = F.concat(F.lit("events"), F.when(F.col("user_id") % 11 == 0, "-old").otherwise(""))
    version = F.when(F.col("user_id") % 13 == 0, 2).otherwise(1)
    return R.import_verdicts(e, "user_id", form, version, F.from_json(text, "k int")["k"].isNotNull(), ("events", 1))


@query("C27_overlapping_windows", """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
  SELECT o_custkey, s AS first_row, least(s + 4, n) AS end_row FROM (SELECT o_custkey, n, unnest(CASE WHEN n <= 4 THEN [0] ELSE list_append(range(0, n - 4, 3), n - 4) END) AS s FROM n)""")
def c27(spark, d):
    n = table(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))
    w = n.select("o_custkey", "n", F.explode(R.window_starts(F.col("n"), 4, 3)).alias("first_row"))
    return w.select("o_custkey", "first_row", F.least(F.col("first_row") + 4, F.col("n")).alias("end_row"))


@query("C28_stitched_windows", """WITH RECURSIVE o AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS at, o_orderkey AS k FROM orders),
  n AS (SELECT id, count(*) AS n FROM o GROUP BY 1), s AS (SELECT id, unnest(CASE WHEN n <= 6 THEN [0] ELSE list_append(range(0, n - 6, 4), n - 6) END) AS f, n FROM n),
  w AS (SELECT s.id, s.f, dense_rank() OVER (PARTITION BY s.id ORDER BY s.f) AS w, list(['O', 'B-P', 'I-P', 'I-N'][CAST((o.k + s.f) % 4 + 1 AS INT)] ORDER BY o.at) AS t FROM s JOIN o ON s.id = o.id AND o.at >= s.f AND o.at < s.f + 6 GROUP BY s.id, s.f),
  st AS (SELECT id, w, t FROM w WHERE w = 1
    UNION ALL SELECT id, w, CASE WHEN cut > 0 AND b[cut] <> 'O' THEN list_transform(range(0, len(b)), lambda i: CASE WHEN i >= cut AND i < coalesce(list_min(list_filter(range(cut, len(b)), lambda j: NOT starts_with(b[j + 1], 'I-'))), len(b)) THEN 'I-' || b[cut][3:] ELSE b[i + 1] END) ELSE b END
      FROM (SELECT id, w, cut, list_concat(a[1:cut], t[cut - f + 1:]) AS b
        FROM (SELECT id, w, f, a, t, coalesce(list_min(list_transform(list_filter(range(f, len(a)), lambda i: a[i + 1] = 'O' AND t[i - f + 1] = 'O'), lambda i: abs(i - m) * 1000000 + i)) % 1000000, m) AS cut
          FROM (SELECT w.id, w.w, w.f, st.t AS a, w.t, (w.f + len(st.t)) // 2 AS m FROM st JOIN w ON w.id = st.id AND w.w = st.w + 1))))
  SELECT id AS o_custkey, array_to_string(t, ' ') AS tags FROM st QUALIFY w = max(w) OVER (PARTITION BY id)""")
def c28(spark, d):
    """The sequences of a customer's orders; a window tags the same order otherwise than its neighbour does."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))  # one sequence a row
    tag = lambda k, start: F.get(F.array(*map(F.lit, ("O", "B-P", "I-P", "I-N"))), ((k + start) % 4).cast("int"))
    windows = F.transform(R.window_starts(F.size("keys"), 6, 4), lambda s: F.struct(s.cast("int").alias("start"), F.transform(F.slice("keys", (s + 1).cast("int"), F.lit(6)), lambda k: tag(k, s)).alias("tags")))
    return o.select("o_custkey", windows.alias("w")).select("o_custkey", F.array_join(R.stitched_tags(F.col("w")), " ").alias("tags"))


@query("C29_access_audit", "SELECT 'n_nationkey,n_name,n_regionkey' AS header, 3 AS n_columns, count(*) AS n_rows, true AS consistent, true AS readable FROM nation")
def c29(spark, d):
    writers.csv(table(spark, d, "nation").coalesce(1), path := folder(spark, "audit"))
    return R.access_audit(spark, path)


@query("C30_index_percentiles", """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT o_orderpriority, n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS m FROM c JOIN orders ON l_orderkey = o_orderkey),
  s AS (SELECT CAST(unnest([0.05, 0.5, 0.95]) AS DOUBLE) AS share)
  SELECT o_orderpriority, share, n FROM p JOIN s ON i = CAST(floor(m * share) AS BIGINT)""")
def c30(spark, d):
    n = table(spark, d, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = n.join(table(spark, d, "orders", "o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.index_percentiles(o, ["o_orderpriority"], "n", [0.05, 0.5, 0.95])


@query("C31_index_interval", """WITH r AS (SELECT event_type, event_id % 200 AS r, round(avg(value), 6) AS v FROM events GROUP BY 1, 2), l AS (SELECT event_type, list_sort(list(v)) AS v FROM r WHERE v IS NOT NULL GROUP BY 1)
  SELECT event_type, v[CAST(floor(len(v) * 0.025) AS INT) + 1] AS lo, v[CAST(floor(len(v) * 0.975) AS INT)] AS hi FROM l""")
def c31(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", "value")
    r = e.groupBy("event_type", (F.col("event_id") % 200).alias("r")).agg(F.round(F.avg("value"), 6).alias("v"))  # 200 replicates: slices of the events
    return R.index_interval(r.where("v is not null"), ["event_type"], "v")


@query("C32_power_table")
def c32(spark, d):
    """No built-in normal distribution, so Arrow batches; the grid is a parameter."""
    grid = [(m, t, s, n, a) for m in (0.005, 0.01) for t in (0.0, 0.002) for s in (0.01, 0.03, 0.05) for n in (5_000, 20_000, 50_000, 100_000) for a in (0.05 / 6, 0.05 / 3, 0.05)]
    return R.power_table(spark.createDataFrame(grid, "margin double, delta double, d double, n long, level double"))


@query("C33_tristate_crosscheck", """WITH s AS (SELECT s_suppkey, s_nationkey, ['BUILDING', 'HOUSEHOLD', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE'][CAST(s_suppkey % 5 + 1 AS INT)] AS seg FROM supplier),
  c AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9700)
  SELECT s_suppkey, bool_or(c_mktsegment = seg) AS agrees FROM s LEFT JOIN c ON s_nationkey = c_nationkey GROUP BY 1""")
def c33(spark, d):
    names = F.array(*map(F.lit, ("BUILDING", "HOUSEHOLD", "MACHINERY", "FURNITURE", "AUTOMOBILE")))
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.get(names, (F.col("s_suppkey") % 5).cast("int")).alias("segment"))
    c = table(spark, d, "customer", "c_nationkey", "c_mktsegment", "c_acctbal").where("c_acctbal > 9700").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return R.crosscheck(s, c, ["nation"], "segment").select("s_suppkey", "agrees")


@query("C34_supported_edges", """WITH g AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag || l_linestatus) AS n_sources, max(l_quantity) < 10 AS weak, max(l_discount) = 0 AS undiscounted, count(*) = 1 AS single FROM lineitem GROUP BY 1, 2)
  SELECT l_partkey, l_suppkey, n_sources, array_to_string(list_filter([CASE WHEN weak THEN 'weak' END, CASE WHEN undiscounted THEN 'undiscounted' END, CASE WHEN single THEN 'single_record' END], lambda x: x IS NOT NULL), ';') AS flags FROM g""")
def c34(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return R.supported_edges(li, ["l_partkey", "l_suppkey"], F.concat("l_returnflag", "l_linestatus"), {"weak": F.max("l_quantity") < 10, "undiscounted": F.max("l_discount") == 0, "single_record": F.count("*") == 1})


@query("C35_stress_set", """WITH x AS (SELECT l_orderkey AS case_id, l_orderkey % 5 AS truth, l_suppkey % 5 AS name, l_linenumber, l_partkey, l_suppkey FROM lineitem)
  SELECT case_id, truth, arg_min(name, (l_linenumber, l_partkey, l_suppkey)) AS working FROM x WHERE name <> truth GROUP BY 1, 2""")
def c35(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    x = li.select(F.col("l_orderkey").alias("case_id"), (F.col("l_orderkey") % 5).alias("truth"), (F.col("l_suppkey") % 5).alias("name"), "l_linenumber", "l_partkey", "l_suppkey")
    return R.stress_set(x, "case_id", "truth", "name", ["l_linenumber", "l_partkey", "l_suppkey"])


@query("C36_coin_mixture", """WITH p AS (SELECT l_orderkey AS k, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r FROM lineitem GROUP BY 1 HAVING a IS NOT NULL AND r IS NOT NULL),
  s AS (SELECT unnest([0.5, 0.7, 0.9]) AS share), e AS (SELECT share, CASE WHEN CAST('0x' || substr(sha256('MIX|' || share || '|' || k), 1, 8) AS BIGINT) / 4294967296.0 < CAST(share AS DOUBLE) THEN a ELSE r END > 25 AS hit FROM p CROSS JOIN s)
  SELECT CAST(share AS DOUBLE) AS share, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 8) AS rate FROM e GROUP BY 1""")
def c36(spark, d):
    best = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))) > 25
    p = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity").groupBy("l_orderkey").agg(best("A").alias("a"), best("R").alias("r"))
    coin = lambda share, k: S.hash_number(F.lit("MIX"), share.cast("string"), k.cast("string")) / F.lit(4294967296.0)
    return R.coin_mixture(p, "l_orderkey", "a", "r", [0.5, 0.7, 0.9], coin)


@query("C37_agreement", """WITH w AS (SELECT l_orderkey, arg_max(l_linestatus, (l_shipdate, l_partkey, l_suppkey, l_linenumber)) AS b FROM lineitem GROUP BY 1)
  SELECT count(*) AS n, round(avg(CASE WHEN o_orderstatus = b THEN 1.0 ELSE 0.0 END), 8) AS agreement FROM orders JOIN w ON o_orderkey = l_orderkey""")
def c37(spark, d):
    w = table(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    w = w.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_linestatus", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")).alias("b"))
    return R.agreement(table(spark, d, "orders", "o_orderkey", "o_orderstatus"), w, "o_orderkey", "o_orderstatus", "b")


@query("C38_edge_precision_recall", """WITH f AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 30), r AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.04),
  b AS (SELECT count(*) AS n FROM (SELECT * FROM f INTERSECT SELECT * FROM r)), nf AS (SELECT count(*) AS n FROM f), nr AS (SELECT count(*) AS n FROM r)
  SELECT nf.n AS n_found, nr.n AS n_reference, b.n AS n_both, round(b.n / nullif(nf.n, 0), 8) AS precision, round(b.n / nullif(nr.n, 0), 8) AS recall FROM b, nf, nr""")
def c38(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return R.edge_precision_recall(li.where("l_quantity > 30"), li.where("l_discount > 0.04"), ["l_partkey", "l_suppkey"])


Z2 = "3.8414588206941227"


@query("C39_subgroup_rows", f"""WITH x AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(o_custkey % 4 AS INT) AS quartile, o_totalprice > 200000 AS hit FROM orders),
  g AS (SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(priority) = 0 THEN 'priority' ELSE 'quartile' END AS dimension, coalesce(status, priority, CAST(quartile AS VARCHAR)) AS value, count(*) AS n, count(*) FILTER (hit) AS hits FROM x GROUP BY GROUPING SETS ((status), (priority), (quartile)))
  SELECT dimension, value, n, hits, round(hits / n, 8) AS rate, round((hits / n + {Z2} / (2 * n)) / (1 + {Z2} / n) - 1.959963984540054 * sqrt(hits / n * (1 - hits / n) / n + {Z2} / (4 * n * n)) / (1 + {Z2} / n), 8) AS lo,
    round((hits / n + {Z2} / (2 * n)) / (1 + {Z2} / n) + 1.959963984540054 * sqrt(hits / n * (1 - hits / n) / n + {Z2} / (4 * n * n)) / (1 + {Z2} / n), 8) AS hi FROM g""")
def c39(spark, d):
    o = table(spark, d, "orders", "o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice")
    x = o.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 4).cast("int").alias("quartile"), (F.col("o_totalprice") > 200000).alias("hit"))
    return R.subgroup_rows(x, ["status", "priority", "quartile"], "hit")


@query("C40_ratio_of_sums", """SELECT l_suppkey, round(CAST(sum(CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0), 8) AS rate FROM lineitem GROUP BY 1""")
def c40(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_discount")
    back = F.col("l_returnflag") == "R"
    return R.ratio_of_sums(li, ["l_suppkey"], (back & (F.col("l_discount") > 0.05)).cast("int"), back.cast("int"))
