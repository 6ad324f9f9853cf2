"""Queries G1 to G18, A33 and A38: closures, components, rules, support."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..registry import query
from .fixtures import OBSERVATIONS, ONTOLOGY, observations, ontology, table

#: Ancestors of every tenth term.
REACH = f"""{ONTOLOGY}, up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM isa WHERE child % 10 = 0 UNION SELECT u.node, i.parent, u.depth + 1 FROM up u JOIN isa i ON u.ancestor = i.child),
  reach AS (SELECT node, ancestor, CAST(min(depth) AS INT) AS depth FROM up GROUP BY ALL)"""


def reach(spark, d, keep="child % 10 = 0"):
    """(node, ancestor, depth) of the terms that `keep` names; None is every term."""
    e = ontology(spark, d)
    return G.closure(e, "child", "parent", e.where(keep).select("child") if keep else None)


def below(spark, d, *terms):
    """(node, ancestor, depth) of the given ancestors only, walked downwards: a row for each node that they reach."""
    tops = spark.createDataFrame([(t,) for t in terms], "parent long")
    return G.closure(ontology(spark, d), "parent", "child", tops).select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor"), "depth")


@query("G1_ancestors", f"WITH RECURSIVE {REACH} SELECT node, ancestor, depth FROM reach")
def g1(spark, d):
    return reach(spark, d)


@query("G2_descendants", f"""WITH RECURSIVE {ONTOLOGY}, dn AS (SELECT child AS node FROM isa WHERE parent = 5 UNION SELECT i.child FROM dn JOIN isa i ON i.parent = dn.node) SELECT node FROM dn""")
def g2(spark, d):
    e = ontology(spark, d)
    return G.closure(e, "parent", "child", spark.createDataFrame([(5,)], "parent long")).select(F.col("ancestor").alias("node"))


@query("G3_shortest_path", f"""WITH RECURSIVE {ONTOLOGY}, w AS (SELECT child AS node, parent AS here, CAST(child AS VARCHAR) || '>' || parent AS path, 1 AS n FROM isa WHERE child % 50 = 0
    UNION ALL SELECT w.node, i.parent, w.path || '>' || i.parent, n + 1 FROM w JOIN isa i ON w.here = i.child)
  SELECT node, min(path) AS path FROM w WHERE here = 0 AND n = (SELECT min(n) FROM w v WHERE v.node = w.node AND v.here = 0) GROUP BY 1""")
def g3(spark, d, keep="child % 50 = 0"):
    """The first shortest path to the root, by string order; a round keeps one path for each (node, term)."""
    return G.first_shortest_paths(ontology(spark, d), keep)


@query("G4_minimum_depth", f"WITH RECURSIVE {REACH} SELECT node, depth FROM reach WHERE ancestor = 0")
def g4(spark, d):
    return reach(spark, d).where("ancestor = 0").select("node", "depth")


LINKS = "links AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey % 3 <> 0)"


def links(spark, d):
    return table(spark, d, "part", "p_partkey").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b"))


# Every link leads to a smaller term, so walking down to where none is left gives the smallest.
DOWN = f"{LINKS}, w AS (SELECT a AS node, b AS here FROM links UNION ALL SELECT w.node, l.b FROM w JOIN links l ON w.here = l.a), low AS (SELECT node, min(here) AS component FROM w GROUP BY 1), comp AS (SELECT * FROM low UNION SELECT DISTINCT component, component FROM low)"


@query("G5_connected_components", f"WITH RECURSIVE {DOWN} SELECT node, component FROM comp")
def g5(spark, d):
    return G.components(links(spark, d), "a", "b")


@query("A33_component_sizes", f"WITH RECURSIVE {DOWN} SELECT component, count(*) AS n FROM comp GROUP BY 1")
def a33(spark, d):
    return G.components(links(spark, d), "a", "b").groupBy("component").agg(F.count("*").alias("n"))


#: Latest status of a term for a patient: orders as records, the part as the term.
RECORDS = "rec AS (SELECT l_suppkey AS patient, l_partkey AS term, max(l_returnflag) AS flag FROM lineitem WHERE l_partkey % 10 = 0 AND l_quantity > 40 GROUP BY ALL)"


def records(spark, d, keep="l_partkey % 10 = 0"):
    li = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity").where(f"{keep} and l_quantity > 40")
    return li.groupBy(F.col("l_suppkey").alias("patient"), F.col("l_partkey").alias("term")).agg(F.max("l_returnflag").alias("flag"))


@query("G6_positive_propagation", f"""WITH RECURSIVE {REACH}, {RECORDS} SELECT DISTINCT r.patient, u.ancestor AS term FROM rec r JOIN reach u ON r.term = u.node WHERE r.flag = 'R' AND NOT EXISTS (SELECT 1 FROM rec x WHERE x.patient = r.patient AND x.term = u.ancestor)""")
def g6(spark, d):
    return propagated(records(spark, d), ontology(spark, d))


#: Records whose ancestors one task keeps apart by patient, about.
TASK_RECORDS = 10_000


def propagated(r, e):
    """Terms above a patient's positive ones that the patient has no record of; both are dealt by patient, as arrays, and told apart there."""
    r = G.stored(r)
    up = G.carried_up(r.where("flag = 'R'"), e, "patient", "term", "child", "parent").withColumn("own", F.lit(False))
    own = r.dropna(subset=["patient", "term"]).select("patient", F.array("term").alias("up"), F.lit(True).alias("own"))
    parts = max(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-r.count() // TASK_RECORDS))
    both = up.unionByName(own).repartition(parts, "patient").select("patient", F.explode("up").alias("term"), "own")
    return both.groupBy("patient", "term").agg(F.bool_or("own").alias("own")).where("not own").select("patient", "term")


@query("G7_leaf_condition", f"""WITH {OBSERVATIONS}, m AS (SELECT o.obs_id, o.status, e.value, CASE WHEN e.event_id % 4 = 0 THEN 'mg' WHEN e.event_id % 4 = 1 THEN NULL ELSE 'g' END AS unit FROM obs o JOIN events e ON o.obs_id = e.event_id)
  SELECT obs_id, CASE WHEN status = 'NEGATIVE' THEN false WHEN status <> 'POSITIVE' THEN NULL WHEN unit IS NULL OR unit <> 'g' THEN NULL ELSE value >= 10 END AS verdict FROM m""")
def g7(spark, d):
    e = table(spark, d, "events", "event_id", "value").withColumn("unit", F.when(F.col("event_id") % 4 == 0, "mg").when(F.col("event_id") % 4 != 1, "g"))
    m = observations(spark, d).select("obs_id", "status").join(e, F.col("obs_id") == F.col("event_id"))
    return m.select("obs_id", G.leaf_verdict(F.col("status"), F.col("value"), F.col("unit"), F.lit(">="), F.lit(10.0), F.lit("g")).alias("verdict"))


VERDICTS = f"{OBSERVATIONS}, v AS (SELECT patient, source AS rule, CASE WHEN source % 3 = 0 THEN 'AND' WHEN source % 3 = 1 THEN 'OR' ELSE 'ATLEAST' END AS op, CASE status WHEN 'POSITIVE' THEN true WHEN 'NEGATIVE' THEN false END AS verdict FROM obs)"


def verdicts(spark, d):
    op = F.when(F.col("source") % 3 == 0, "AND").when(F.col("source") % 3 == 1, "OR").otherwise("ATLEAST")
    return observations(spark, d).select("patient", F.col("source").alias("rule"), op.alias("op"), F.when(F.col("status") == "POSITIVE", True).when(F.col("status") == "NEGATIVE", False).alias("verdict"))


@query("G8_rule_combination", f"""WITH {VERDICTS} SELECT patient, rule, CASE any_value(op) WHEN 'AND' THEN CASE WHEN count(*) FILTER (verdict = false) > 0 THEN false WHEN count(*) FILTER (verdict IS NULL) > 0 THEN NULL ELSE true END
    WHEN 'OR' THEN CASE WHEN count(*) FILTER (verdict) > 0 THEN true WHEN count(*) FILTER (verdict IS NULL) > 0 THEN NULL ELSE false END
    ELSE CASE WHEN count(*) FILTER (verdict) >= 2 THEN true WHEN count(*) FILTER (verdict) + count(*) FILTER (verdict IS NULL) < 2 THEN false END END AS verdict FROM v GROUP BY ALL""")
def g8(spark, d):
    v = verdicts(spark, d)
    some = G.combined(v.where("op <> 'ATLEAST'"), ["patient", "rule"], "op", "verdict")
    return some.unionByName(G.at_least(v.where("op = 'ATLEAST'"), ["patient", "rule"], "verdict", F.lit(2)))


#: Edges of the knowledge graph: each nation suggests or argues against findings.
KG = "kg AS (SELECT n_nationkey AS disease, ['click','view','error','purchase','signup'][1 + (n_nationkey + k) % 5] AS node, CASE WHEN (n_nationkey + k) % 3 = 0 THEN 'ARGUES_AGAINST' ELSE 'SUGGESTS' END AS rel, CAST((n_nationkey * k) % 4 AS INT) AS grade FROM nation CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE n_nationkey < 20)"


def knowledge(spark, d):
    nodes = F.array(*map(F.lit, ("click", "view", "error", "purchase", "signup")))
    n = table(spark, d, "nation", "n_nationkey").where("n_nationkey < 20").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    s = (F.col("n_nationkey") + F.col("k"))
    return n.select(F.col("n_nationkey").alias("disease"), F.element_at(nodes, s % 5 + 1).alias("node"), F.when(s % 3 == 0, "ARGUES_AGAINST").otherwise("SUGGESTS").alias("rel"), (F.col("n_nationkey") * F.col("k") % 4).cast("int").alias("grade"))


VIEW = "view AS (SELECT patient, node, max_by(status, recorded_at) AS status FROM obs GROUP BY ALL)"


def latest_view(spark, d):
    return observations(spark, d).groupBy("patient", "node").agg(F.max_by("status", F.struct("recorded_at", "obs_id")).alias("status"))


PATHS = f"""{OBSERVATIONS}, {VIEW}, {KG}, path AS (SELECT v.patient, k.disease, k.node, k.rel, k.grade, CASE WHEN status = 'POSITIVE' THEN CASE rel WHEN 'SUGGESTS' THEN 'SUPPORT' ELSE 'CONFLICT' END
    WHEN status = 'NEGATIVE' AND rel = 'SUGGESTS' THEN 'CONFLICT' WHEN status = 'NEGATIVE' THEN 'CLEARED' ELSE 'UNDETERMINED' END AS state FROM view v JOIN kg k ON v.node = k.node)"""


def paths(spark, d):
    p = latest_view(spark, d).join(knowledge(spark, d), "node")
    positive, negative, suggests = F.col("status") == "POSITIVE", F.col("status") == "NEGATIVE", F.col("rel") == "SUGGESTS"
    state = F.when(positive, F.when(suggests, "SUPPORT").otherwise("CONFLICT")).when(negative & suggests, "CONFLICT").when(negative, "CLEARED").otherwise("UNDETERMINED")
    return p.select("patient", "disease", "node", "rel", "grade", state.alias("state"))


@query("G9_path_evaluation", f"WITH {PATHS} SELECT patient, disease, node, rel, state FROM path")
def g9(spark, d):
    return paths(spark, d).select("patient", "disease", "node", "rel", "state")


@query("G10_independent_support", f"""WITH {PATHS}, s AS (SELECT DISTINCT p.patient, p.disease, o.source, p.grade FROM path p JOIN obs o ON o.patient = p.patient AND o.node = p.node WHERE p.state = 'SUPPORT')
  SELECT patient, disease, count(DISTINCT source) AS n_groups, max(grade) AS best_grade FROM s GROUP BY ALL""")
def g10(spark, d):
    o = observations(spark, d).select("patient", "node", "source").distinct()
    s = paths(spark, d).where("state = 'SUPPORT'").join(o, ["patient", "node"])
    return s.groupBy("patient", "disease").agg(F.count_distinct("source").alias("n_groups"), F.max("grade").alias("best_grade"))


RANKED = f"{PATHS}, agg AS (SELECT patient, disease, count(*) FILTER (state = 'SUPPORT') AS n_support, count(*) FILTER (state = 'CONFLICT') AS n_conflict FROM path GROUP BY ALL)"


def ranked(spark, d):
    return paths(spark, d).groupBy("patient", "disease").agg(F.count_if(F.col("state") == "SUPPORT").alias("n_support"), F.count_if(F.col("state") == "CONFLICT").alias("n_conflict"))


@query("G11_ranking", f"WITH {RANKED} SELECT patient, disease, n_support, n_conflict, row_number() OVER (PARTITION BY patient ORDER BY n_support DESC, n_conflict, disease) AS place FROM agg")
def g11(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("patient").orderBy(F.desc("n_support"), "n_conflict", "disease")
    return ranked(spark, d).withColumn("place", F.row_number().over(w).cast("long"))


@query("G12_affected_set", f"""WITH RECURSIVE {ONTOLOGY}, up AS (SELECT child, parent FROM isa WHERE child IN (17, 40, 99) UNION SELECT u.child, i.parent FROM up u JOIN isa i ON u.parent = i.child) SELECT DISTINCT parent AS term FROM up WHERE parent % 2 = 1""")
def g12(spark, d):
    changed = spark.createDataFrame([(17,), (40,), (99,)], "child long")
    return G.closure(ontology(spark, d), "child", "parent", changed).select(F.col("ancestor").alias("term")).distinct().where("term % 2 = 1")


@query("G13_working_assessment", f"""WITH {RANKED}, w AS (SELECT patient, disease FROM agg QUALIFY row_number() OVER (PARTITION BY patient ORDER BY n_support DESC, n_conflict, disease) = 1),
  e AS (SELECT p.patient, p.node, bool_or(p.disease = w.disease AND p.state = 'SUPPORT') AS own, bool_or(p.disease = w.disease AND p.state = 'CONFLICT') AS against, bool_or(p.disease <> w.disease AND p.state = 'SUPPORT') AS other FROM path p JOIN w ON p.patient = w.patient GROUP BY ALL)
  SELECT patient, node, CASE WHEN own THEN 'SUPPORTED' WHEN against THEN 'CONFLICT' WHEN other THEN 'UNEXPLAINED' ELSE 'UNDETERMINED' END AS class FROM e""")
def g13(spark, d):
    p = paths(spark, d)
    best = ranked(spark, d).groupBy("patient").agg(F.min_by("disease", F.struct(-F.col("n_support"), "n_conflict", "disease")).alias("working"))
    own = F.col("disease") == F.col("working")
    e = p.join(best, "patient").groupBy("patient", "node").agg(F.bool_or(own & (F.col("state") == "SUPPORT")).alias("own"), F.bool_or(own & (F.col("state") == "CONFLICT")).alias("against"), F.bool_or(~own & (F.col("state") == "SUPPORT")).alias("other"))
    return e.select("patient", "node", F.when(F.col("own"), "SUPPORTED").when(F.col("against"), "CONFLICT").when(F.col("other"), "UNEXPLAINED").otherwise("UNDETERMINED").alias("class"))


@query("G14_structural_specificity", f"WITH RECURSIVE {REACH}, k AS (SELECT ancestor, count(DISTINCT node) AS n FROM reach GROUP BY 1) SELECT node, round(sum(1.0 / n), 8) AS specificity FROM reach JOIN k USING (ancestor) GROUP BY 1")
def g14(spark, d):
    return specificity(reach(spark, d))


def specificity(r):
    n = r.groupBy("ancestor").agg(F.count_distinct("node").alias("n"))
    return r.join(n, "ancestor").groupBy("node").agg(F.round(F.sum(1.0 / F.col("n")), 8).alias("specificity"))


@query("G15_edge_constraints", f"""WITH {KG} SELECT disease, node, rel, CASE WHEN node = 'signup' THEN 'WRONG_KIND' WHEN grade = 0 THEN 'NO_TIER' END AS fault FROM kg WHERE node = 'signup' OR grade = 0""")
def g15(spark, d):
    fault = F.when(F.col("node") == "signup", "WRONG_KIND").when(F.col("grade") == 0, "NO_TIER")
    return knowledge(spark, d).select("disease", "node", "rel", fault.alias("fault")).where("fault is not null")


@query("G16_multi_source_edges", f"""WITH {KG}, x AS (SELECT disease, node FROM kg WHERE grade = 0) SELECT disease, node, 'kg' AS source FROM kg WHERE grade > 0 UNION
  SELECT DISTINCT CAST(s_nationkey AS INT), e, 'supplier' FROM supplier CROSS JOIN (VALUES ('click'), ('view')) v(e) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.disease = s_nationkey AND x.node = e)""")
def g16(spark, d):
    kg = knowledge(spark, d)
    excluded = kg.where("grade = 0").select("disease", "node")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("disease"), F.explode(F.array(F.lit("click"), F.lit("view"))).alias("node")).distinct()
    return kg.where("grade > 0").select("disease", "node", F.lit("kg").alias("source")).distinct().unionByName(s.join(excluded, ["disease", "node"], "left_anti").withColumn("source", F.lit("supplier")))


PAIRS = "pr AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey % 10 = 0 AND l_linenumber = 1)"


@query("G17_semantic_relation", f"""WITH RECURSIVE {REACH}, {PAIRS} SELECT a, b, CASE WHEN a = b THEN 'same' WHEN EXISTS (SELECT 1 FROM reach r WHERE r.node = a AND r.ancestor = b AND depth <= 3) THEN 'broader'
  WHEN EXISTS (SELECT 1 FROM reach r WHERE r.node = b AND r.ancestor = a AND depth <= 3) THEN 'narrower' ELSE 'none' END AS relation FROM pr""")
def g17(spark, d):
    return relations(table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_linenumber").where("l_partkey % 10 = 0 and l_linenumber = 1"), reach(spark, d))


def relations(li, ancestors):
    r = ancestors.where("depth <= 3").select(F.col("node").alias("x"), F.col("ancestor").alias("y"), F.lit(True).alias("hit"))
    p = li.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    up = p.join(r.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("hit").alias("up")), ["a", "b"], "left").join(r.select(F.col("x").alias("b"), F.col("y").alias("a"), F.col("hit").alias("down")), ["a", "b"], "left")
    return up.select("a", "b", F.when(F.col("a") == F.col("b"), "same").when(F.col("up"), "broader").when(F.col("down"), "narrower").otherwise("none").alias("relation"))


@query("G18_relation_matrix", f"""WITH {KG} SELECT disease, node, CASE WHEN bool_or(rel = 'SUGGESTS') THEN 1 ELSE -1 END AS sign FROM kg GROUP BY ALL""")
def g18(spark, d):
    return knowledge(spark, d).groupBy("disease", "node").agg(F.when(F.bool_or(F.col("rel") == "SUGGESTS"), 1).otherwise(-1).alias("sign"))


@query("A38_closure_coverage", f"""WITH RECURSIVE {REACH}, {RECORDS} SELECT r.patient, count(DISTINCT r.term) AS n_terms, count(DISTINCT CASE WHEN r.term % 4 = 0 THEN r.term END) AS exact,
  count(DISTINCT CASE WHEN u.ancestor IS NOT NULL THEN r.term END) AS by_hierarchy FROM rec r LEFT JOIN reach u ON u.node = r.term AND u.ancestor IN (3, 7, 20) GROUP BY 1""")
def a38(spark, d):
    return coverage(records(spark, d), reach(spark, d))


def coverage(rec, ancestors):
    up = ancestors.where(F.col("ancestor").isin(3, 7, 20)).select(F.col("node").alias("term")).distinct().withColumn("hit", F.lit(True))
    r = rec.join(up, "term", "left")
    return r.groupBy("patient").agg(F.count_distinct("term").alias("n_terms"), F.count_distinct(F.when(F.col("term") % 4 == 0, F.col("term"))).alias("exact"), F.count_distinct(F.when(F.col("hit"), F.col("term"))).alias("by_hierarchy"))
