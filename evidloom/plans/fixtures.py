"""Views over the driver tables that stand for the domain's tables, as DataFrames and as SQL.

Orders are cases with a priority as label; line items are their evidence tokens;
events are bitemporal observations, and a signup opens a stay of 24 hours; part
keys form an ontology whose terms have two parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stay_id, user_id, intime, outtime)."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("stay_id"), "user_id", F.col("ts").alias("intime"), F.expr("ts + interval 24 hours").alias("outtime"))


STAYS = "stays AS (SELECT event_id AS stay_id, user_id, ts AS intime, ts + INTERVAL 24 HOURS AS outtime FROM events WHERE event_type = 'signup')"

STATUSES = ("POSITIVE", "NEGATIVE", "UNCERTAIN", "NOT_TESTED", "NOT_RECORDED")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, patient, node, status, observed_at, recorded_at, source): knowledge comes up to three days late."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 5 + 1).cast("int"))
    late = F.make_interval(hours=(F.col("event_id") % 72).cast("int"))
    return e.select(F.col("event_id").alias("obs_id"), F.col("user_id").alias("patient"), F.col("event_type").alias("node"), status.alias("status"), F.col("ts").alias("observed_at"), (F.col("ts") + late).alias("recorded_at"), (F.col("event_id") % 7).alias("source"))


OBSERVATIONS = """obs AS (SELECT event_id AS obs_id, user_id AS patient, event_type AS node,
  ['POSITIVE','NEGATIVE','UNCERTAIN','NOT_TESTED','NOT_RECORDED'][CAST(event_id % 5 + 1 AS INT)] AS status,
  ts AS observed_at, ts + to_hours(CAST(event_id % 72 AS INT)) AS recorded_at, event_id % 7 AS source FROM events)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, code, value): evidence tokens of each line item, repeats in an order and all, not shuffled."""
    return _tokens(_items(spark, sf_dir))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    band = F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("string")
    return li.select(F.col("l_orderkey").alias("case_id"), "l_returnflag", "l_linestatus", band.alias("band"))


def _tokens(items: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("code"), v.alias("value")) for c, v in (("E_1", F.col("l_returnflag")), ("E_2", F.col("l_linestatus")), ("E_3", F.concat(F.lit("V_"), "band")))])
    return items.select("case_id", F.explode(pairs).alias("t")).select("case_id", "t.code", "t.value")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, code, value): distinct evidence tokens of each order; line items are dealt by order once, before they become tokens."""
    return _tokens(_items(spark, sf_dir).repartition("case_id")).distinct()


TOKENS = """tokens AS (SELECT DISTINCT l_orderkey AS case_id, code, value FROM (
  SELECT l_orderkey, 'E_1' AS code, l_returnflag AS value FROM lineitem
  UNION ALL SELECT l_orderkey, 'E_2', l_linestatus FROM lineitem
  UNION ALL SELECT l_orderkey, 'E_3', 'V_' || CAST(least(CAST(floor(l_quantity / 10) AS INT), 4) AS VARCHAR) FROM lineitem))"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, label, total, age): orders; the age is made from the customer's key."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey")
    return o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("total"), (F.col("o_custkey") % 100).cast("int").alias("age"))


CASES = "cases AS (SELECT o_orderkey AS case_id, o_orderpriority AS label, o_totalprice AS total, CAST(o_custkey % 100 AS INT) AS age FROM orders)"


def likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, value, label, p): Laplace-smoothed share of a label's tokens of a code that have the value."""
    from ..operators.aggregates import smoothed_likelihood

    return smoothed_likelihood(evidence(spark, sf_dir), cases(spark, sf_dir).select("case_id", "label"), "case_id", "label", "code", "value", once=True)


LIKELIHOOD = f"""{TOKENS}, {CASES},
cnt AS (SELECT code, value, label, count(*) AS n FROM tokens JOIN cases USING (case_id) GROUP BY ALL),
space AS (SELECT * FROM (SELECT DISTINCT code, value FROM cnt) CROSS JOIN (SELECT DISTINCT label FROM cases)),
likelihood AS (SELECT s.code, s.value, s.label, (coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY s.code, s.label) + count(*) OVER (PARTITION BY s.code, s.label)) AS p
  FROM space s LEFT JOIN cnt c ON s.code = c.code AND s.value = c.value AND s.label = c.label)"""


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): part k is below k div 2 and k div 3."""
    p = table(spark, sf_dir, "part", "p_partkey").where("p_partkey > 0")
    return p.select(F.col("p_partkey").alias("child"), F.explode(F.array_distinct(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3")))).alias("parent"))


ONTOLOGY = "isa AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0)"
