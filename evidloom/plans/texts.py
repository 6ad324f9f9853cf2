"""Queries X1 to X15, F45 to F47, C18, C19 and C21: text pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import texts as X
from ..operators import validation as V
from ..operators.vectors import nearest_by_cosine
from ..operators.windows import micros
from ..registry import query
from .fixtures import OBSERVATIONS, TOKENS, observations, table, tokens

ALIASES = [("the", "E_1"), ("and", "E_1"), ("der", "E_2"), ("la", "E_3"), ("el", "E_3"), ("en", "E_4")]
NEGATIONS = ["er", "an", "le", "de"]
ALIAS_SQL = "alias(word, code) AS (VALUES ('the', 'E_1'), ('and', 'E_1'), ('der', 'E_2'), ('la', 'E_3'), ('el', 'E_3'), ('en', 'E_4'))"
WORDS = r"""wd AS (SELECT conv_id, turn, CAST(i - 1 AS INT) AS pos, regexp_replace(ws[i], '^[.,;:!?]+|[.,;:!?]+$', '', 'g') AS word FROM (SELECT conv_id, turn, string_split_regex(lower(text), '[\t\n\f\r ]') AS ws FROM conversations), range(1, 100000) r(i) WHERE i <= len(ws))"""
MENTIONS = f"""{WORDS}, {ALIAS_SQL}, ng AS (SELECT *, coalesce(bool_or(word IN ('er', 'an', 'le', 'de')) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), false) AS neg FROM wd),
  men AS (SELECT conv_id, turn, pos, code, CASE WHEN neg THEN 'NEGATIVE' ELSE 'POSITIVE' END AS polarity FROM ng JOIN alias USING (word))"""


def mentions(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    aliases = spark.createDataFrame(ALIASES, "word string, code string")
    return X.mentions(X.word_table(c, ["conv_id", "turn"], "text"), aliases, ["conv_id", "turn"], NEGATIONS)


@query("X1_alias_mapper", f"WITH {MENTIONS} SELECT conv_id, turn, pos, code, polarity FROM men")
def x1(spark, d):
    return mentions(spark, d)


# Parts as aliases with faults of each kind; suppliers as the catalogue, nations as the policy.
ENTRIES = """SELECT 'a' || (p_partkey - CASE WHEN p_partkey % 31 = 30 THEN 1 ELSE 0 END) AS id, 'E_' || p_size AS evidence_id, CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN '{NEG}' || p_name WHEN p_partkey % 23 = 0 THEN '(' || p_name || ')?' WHEN p_partkey % 29 = 0 THEN '{SIGN}' || p_name ELSE p_name END AS pattern,
  CASE WHEN p_partkey % 13 = 0 THEN 'verb' ELSE 'noun' END AS kind, CASE WHEN p_partkey % 11 = 0 THEN 'MAYBE' WHEN p_partkey % 3 = 0 THEN 'POSITIVE' END AS status FROM part"""
CATALOGUE = "SELECT DISTINCT 'E_' || (s_suppkey % 46) AS evidence_id, CASE WHEN s_suppkey % 46 % 4 = 3 THEN 'C' ELSE 'B' END AS data_type FROM supplier"
POLICY = "SELECT 'E_' || (n_nationkey * 2 - CASE WHEN n_nationkey = 9 THEN 2 ELSE 0 END) AS evidence_id, n_nationkey % 2 = 0 AS allowed, CASE WHEN n_nationkey % 5 <> 0 THEN 'told' END AS reason FROM nation"


@query("X2_alias_table_contract", f"""WITH al AS (SELECT id, evidence_id, replace(pattern, '{{SIGN}}', 'not ') AS pattern, kind, status, kind = 'verb' AS bad FROM ({ENTRIES})), ca AS ({CATALOGUE}), po AS ({POLICY}),
  j AS (SELECT al.*, ca.evidence_id IS NOT NULL AS known, data_type FROM al LEFT JOIN ca USING (evidence_id)), pn AS (SELECT evidence_id, count(*) AS n, bool_and(allowed IS NOT NULL AND coalesce(reason, '') <> '') AS told FROM po GROUP BY 1), su AS (SELECT evidence_id FROM ca WHERE data_type = 'B'),
  b AS (SELECT 'alias' AS side, id, 'UNKNOWN_EVIDENCE' AS rule FROM j WHERE NOT known UNION ALL SELECT 'alias', id, 'EXCLUDED_EVIDENCE' FROM j WHERE evidence_id = 'E_7' UNION ALL SELECT 'alias', id, 'NOT_BINARY' FROM j WHERE known AND data_type <> 'B' UNION ALL SELECT 'alias', id, 'EMPTY_PATTERN' FROM j WHERE pattern = ''
    UNION ALL SELECT 'alias', id, 'UNRESOLVED_MACRO' FROM j WHERE contains(pattern, '{{NEG}}') UNION ALL SELECT 'alias', id, 'MATCHES_EMPTY' FROM j WHERE pattern LIKE '%)?' UNION ALL SELECT 'alias', id, 'BAD_KIND' FROM j WHERE bad UNION ALL SELECT 'alias', id, 'BAD_ALLOW' FROM j WHERE bad UNION ALL SELECT 'alias', id, 'BAD_STATUS' FROM j WHERE status = 'MAYBE'
    UNION ALL SELECT 'alias', id, 'DUPLICATE_ID' FROM al GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'policy', evidence_id, 'MISSING' FROM su ANTI JOIN pn USING (evidence_id) UNION ALL SELECT 'policy', evidence_id, 'EXTRA' FROM pn ANTI JOIN su USING (evidence_id) UNION ALL SELECT 'policy', evidence_id, 'DUPLICATE' FROM pn WHERE n > 1 UNION ALL SELECT 'policy', evidence_id, 'NO_REASON' FROM pn WHERE NOT told)
  SELECT DISTINCT side, id, rule FROM b""")
def x2(spark, d):
    statuses = ("POSITIVE", "NEGATIVE")
    name, k = F.col("p_name"), F.col("p_partkey")
    allow = F.when(k % 13 == 0, F.array(F.lit("POSITIVE"), F.lit("OTHER"))).otherwise(F.array(*map(F.lit, statuses)))
    aliases = table(spark, d, "part", "p_partkey", "p_name", "p_size").select(
        F.concat(F.lit("a"), k - F.when(k % 31 == 30, 1).otherwise(0)).alias("id"), F.concat(F.lit("E_"), "p_size").alias("evidence_id"),
        F.when(k % 17 == 0, "").when(k % 19 == 0, F.concat(F.lit("{NEG}"), name)).when(k % 23 == 0, F.concat(F.lit("("), name, F.lit(")?"))).when(k % 29 == 0, F.concat(F.lit("{SIGN}"), name)).otherwise(name).alias("pattern"),
        F.when(k % 13 == 0, "verb").otherwise("noun").alias("kind"), allow.alias("allow"), F.when(k % 11 == 0, "MAYBE").when(k % 3 == 0, "POSITIVE").alias("status"))
    code = F.col("s_suppkey") % 46
    catalogue = table(spark, d, "supplier", "s_suppkey").select(F.concat(F.lit("E_"), code).alias("evidence_id"), F.when(code % 4 == 3, "C").otherwise("B").alias("data_type")).distinct()
    n = F.col("n_nationkey")
    policy = table(spark, d, "nation", "n_nationkey").select(F.concat(F.lit("E_"), n * 2 - F.when(n == 9, 2).otherwise(0)).alias("evidence_id"), (n % 2 == 0).alias("allowed"), F.when(n % 5 != 0, "told").alias("reason"))
    a = V.alias_violations(aliases, catalogue, statuses, excluded=("E_7",), macros={"SIGN": "not "}).select(F.lit("alias").alias("side"), "id", "rule")
    return a.unionByName(V.policy_violations(policy, catalogue.where("data_type = 'B'")).select(F.lit("policy").alias("side"), F.col("evidence_id").alias("id"), "rule"))


NOTE = "event_type || CASE WHEN event_id % 3 = 0 THEN ' for ' || event_id % 9 || ' days' ELSE '' END || ' ' || event_id % 11 || '/10' || CASE event_id % 4 WHEN 0 THEN ', getting worse' WHEN 1 THEN ', better' ELSE '' END"


def notes(spark, d):
    k = F.col("event_id")
    text = F.concat(F.col("event_type"), F.when(k % 3 == 0, F.concat(F.lit(" for "), k % 9, F.lit(" days"))).otherwise(""), F.lit(" "), k % 11, F.lit("/10"), F.when(k % 4 == 0, ", getting worse").when(k % 4 == 1, ", better").otherwise(""))
    return table(spark, d, "events", "event_id", "event_type", "ts").select("event_id", "ts", text.alias("note"))


@query("X3_record_extractor", "SELECT event_id, event_type AS symptom, (event_id % 11) / 10.0::DOUBLE AS severity, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) - CAST(event_id % 9 AS INT) END AS onset, CASE event_id % 4 WHEN 0 THEN 'worsening' WHEN 1 THEN 'improving' END AS trend FROM events")
def x3(spark, d):
    n = notes(spark, d)
    days = F.regexp_extract("note", r"for (\d+) days", 1).try_cast("int")
    trend = F.when(F.col("note").contains("worse"), "worsening").when(F.col("note").contains("better"), "improving")
    return n.select("event_id", F.regexp_extract("note", r"^(\w+)", 1).alias("symptom"), S.severity(F.col("note")).alias("severity"), F.date_sub(F.to_date("ts"), days).alias("onset"), trend.alias("trend"))


@query("X4_tiered_retrieval", """WITH q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'a ' || p_name ELSE replace(p_name, ' ', '-') || 'x' END AS q FROM part),
  t AS (SELECT p_name AS term, min(p_partkey) AS concept FROM part GROUP BY 1),
  gq AS (SELECT q, list_distinct(list_transform(range(1, length(q)), lambda i: substr(q, i, 2))) AS g FROM q), gt AS (SELECT term, concept, list_distinct(list_transform(range(1, length(term)), lambda i: substr(term, i, 2))) AS g FROM t),
  s AS (SELECT q, concept, len(list_intersect(gq.g, gt.g)) / (len(gq.g) + len(gt.g) - len(list_intersect(gq.g, gt.g))) AS s FROM gq JOIN gt ON len(list_intersect(gq.g, gt.g)) > 0),
  b AS (SELECT q, concept FROM s WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, concept) = 1),
  p AS (SELECT q, concept FROM q JOIN t ON contains(' ' || q || ' ', ' ' || term || ' ') QUALIFY row_number() OVER (PARTITION BY q ORDER BY length(term) DESC, concept DESC) = 1)
  SELECT q.q AS query, coalesce(e.concept, p.concept, b.concept) AS concept, CASE WHEN e.concept IS NOT NULL THEN 'EXACT' WHEN p.concept IS NOT NULL THEN 'PHRASE' WHEN b.concept IS NOT NULL THEN 'NGRAM' ELSE 'NONE' END AS tier
  FROM q LEFT JOIN t e ON q.q = e.term LEFT JOIN p ON q.q = p.q LEFT JOIN b ON q.q = b.q""")
def x4(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name")
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a "), "p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("x")))
    terms = p.groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("concept"))
    return X.tiered_retrieval(p.select(text.alias("query")).distinct(), terms, "query", "term", "concept", S.ngrams(F.col("_t"), 2), 0.3)


@query("X5_contiguous_phrase", "SELECT p_partkey, contains(' ' || p_type || ' ' || p_name || ' ', ' PROMO red ') OR contains(' ' || p_type || ' ' || p_name || ' ', ' bolt ') AS hit FROM part")
def x5(spark, d):
    words = F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    hit = X.holds_in_order(words, F.array(F.lit("PROMO"), F.lit("red"))) | X.holds_in_order(words, F.array(F.lit("bolt")))
    return table(spark, d, "part", "p_partkey", "p_type", "p_name").select("p_partkey", hit.alias("hit"))


@query("X6_agreement_routing", """WITH n AS (SELECT DISTINCT p_name, list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2))) AS ga, list_distinct(string_split(p_name, ' ')) AS gb FROM part),
  t AS (SELECT 'a' AS m, p_name, unnest(ga) AS g FROM n UNION ALL SELECT 'b', p_name, unnest(gb) FROM n), c AS (SELECT m, p_type, g, count(*) AS k FROM part JOIN t USING (p_name) WHERE p_partkey % 5 <> 0 GROUP BY ALL), v AS (SELECT m, count(DISTINCT g) AS v FROM c GROUP BY 1),
  b AS (SELECT c.m, p_type, ln(sum(k) + any_value(v)) AS base FROM c JOIN v ON c.m = v.m GROUP BY c.m, p_type), s AS (SELECT t.m, t.p_name, b.p_type, round(sum(ln(coalesce(k, 0) + 1) - base), 6) AS score FROM t JOIN b ON t.m = b.m LEFT JOIN c ON c.m = t.m AND c.p_type = b.p_type AND c.g = t.g GROUP BY ALL),
  r AS (SELECT m, p_name, p_type, round(score - lead(score) OVER w, 6) AS margin, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY m, p_name ORDER BY score DESC, p_type))
  SELECT p_partkey, a.p_type AS by_grams, b.p_type AS by_words, CASE WHEN a.p_type = b.p_type AND a.margin >= 0.1 THEN 'AUTO' WHEN a.p_type = b.p_type THEN 'CONFIRM' WHEN b.margin >= 0.1 THEN 'ASK' ELSE 'HOLD' END AS route
  FROM part JOIN r a ON a.m = 'a' AND a.k = 1 AND a.p_name = part.p_name JOIN r b ON b.m = 'b' AND b.k = 1 AND b.p_name = part.p_name""")
def x6(spark, d):
    """Two linear classifiers of a name, by character bigrams and by words, learned from four fifths of the parts; distinct names are scored once."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type")
    train, names = p.where("p_partkey % 5 <> 0"), p.select("p_name").distinct()
    by = lambda grams, k: X.best_class(X.class_scores(train, names, "p_type", grams, "p_name"), "p_name", "p_type").select("p_name", F.col("p_type").alias(k), F.col("margin").alias(f"{k}_margin"))
    both = by(S.ngrams(F.col("p_name"), 2), "by_grams").join(by(F.array_distinct(F.split("p_name", " ")), "by_words"), "p_name")
    route = X.agreement_route(F.col("by_grams"), F.col("by_words"), F.col("by_grams_margin"), F.col("by_words_margin"), 0.1)
    return p.select("p_partkey", "p_name").join(both, "p_name").select("p_partkey", "by_grams", "by_words", route.alias("route"))


SENTENCES = r"sen AS (SELECT conv_id, turn, CAST(i - 1 AS INT) AS sentence_no, ss[i] AS sentence FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!?\n]'), lambda s: trim(s, ' ')), lambda s: s <> '') AS ss FROM conversations), range(1, 10000) r(i) WHERE i <= len(ss))"


@query("X7_clause_context", f"""WITH {SENTENCES} SELECT conv_id, turn, sentence_no, regexp_matches(sentence, '(^| )(le|de|er) ') AS negated, last_value(CASE WHEN contains(sentence, ',') THEN sentence_no END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY sentence_no ROWS UNBOUNDED PRECEDING) AS context FROM sen""")
def x7(spark, d):
    s = X.sentences(table(spark, d, "conversations", "conv_id", "turn", "text"), ["conv_id", "turn"], "text")
    w = Window.partitionBy("conv_id", "turn").orderBy("sentence_no").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("conv_id", "turn", "sentence_no", F.col("sentence").rlike("(^| )(le|de|er) ").alias("negated"), F.last(F.when(F.contains("sentence", F.lit(",")), F.col("sentence_no")), ignorenulls=True).over(w).alias("context"))


@query("X8_conflict_hold", f"""WITH {MENTIONS} SELECT conv_id, code, CASE WHEN count(DISTINCT polarity) > 1 THEN 'HOLD' ELSE min(polarity) END AS status, count(*) AS n FROM men GROUP BY ALL""")
def x8(spark, d):
    return mentions(spark, d).groupBy("conv_id", "code").agg(F.when(F.count_distinct("polarity") > 1, "HOLD").otherwise(F.min("polarity")).alias("status"), F.count("*").alias("n"))


@query("X9_label_consolidation", """WITH n AS (SELECT replace(p_name, ' ', '') AS g, p_name, p_type, count(*) AS n FROM part GROUP BY ALL),
  s AS (SELECT g, p_name FROM (SELECT g, p_name, sum(n) AS n FROM n GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, p_name) = 1),
  l AS (SELECT g, p_type, count(*) OVER (PARTITION BY g) AS n_labels FROM (SELECT g, p_type, sum(n) AS n FROM n GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, p_type) = 1)
  SELECT s.g AS "group", p_type, n_labels, p_name FROM s JOIN l ON s.g = l.g""")
def x9(spark, d):
    return X.consolidated(table(spark, d, "part", "p_name", "p_type"), "p_name", "p_type")


@query("X10_concept_audit", """WITH c AS (SELECT p_name, p_type, list(DISTINCT ['G1_SINGLE', 'REJECTED', 'G1_SINGLE', 'G2_SILVER_AGREED', 'REJECTED', 'G3_SILVER_AUDITED', 'G1_SINGLE'][p_size % 7 + 1]) AS grades, ['A', 'B', 'C', 'D', 'E', 'F'][CAST(min(p_partkey) % 6 + 1 AS INT)] AS class, bool_and(p_size % 2 = 0) AS failed FROM part GROUP BY ALL),
  s AS (SELECT *, list_contains(grades, 'G2_SILVER_AGREED') OR list_contains(grades, 'G3_SILVER_AUDITED') AS sure FROM c)
  SELECT p_name, p_type, CASE WHEN sure THEN CASE class WHEN 'D' THEN 'KEEP_NEW_CANDIDATE' WHEN 'E' THEN 'REJECTED' WHEN 'F' THEN 'HELD' ELSE 'MERGE_AS_EXISTING_RELATION' END WHEN list_contains(grades, 'REJECTED') THEN 'REJECTED' ELSE 'HELD' END AS audit, failed AS isolation_failed FROM s""")
def x10(spark, d):
    grade = F.element_at(F.array(*map(F.lit, ("G1_SINGLE", "REJECTED", "G1_SINGLE", "G2_SILVER_AGREED", "REJECTED", "G3_SILVER_AUDITED", "G1_SINGLE"))), (F.col("p_size") % 7 + 1).cast("int"))
    final = F.element_at(F.array(*map(F.lit, "ABCDEF")), (F.min("p_partkey") % 6 + 1).cast("int"))
    c = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size").groupBy("p_name", "p_type").agg(F.collect_set(grade).alias("grades"), final.alias("class"), F.bool_and(F.col("p_size") % 2 == 0).alias("isolation_failed"))
    return c.select("p_name", "p_type", S.audit_decision(F.col("grades"), F.col("class")).alias("audit"), "isolation_failed")


@query("X11_embedding_neighbours", """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, round(list_cosine_similarity(q.e, v.e), 6) AS cosine FROM n q JOIN n v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY cosine DESC, id) = 1) SELECT query_id, id, label, cosine FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, label) <= 3""")
def x11(spark, d):
    return nearest_by_cosine(table(spark, d, "embeddings"), "vec_id", "embedding", "label", F.col("vec_id") % 20 == 0, 3)


@query("X11_indexed_neighbours")
def x11_indexed(spark, d):
    """As X11 by an index of 64 inverted lists; a test measures its recall against the exact form."""
    return nearest_by_cosine(table(spark, d, "embeddings"), "vec_id", "embedding", "label", F.col("vec_id") % 20 == 0, 3, centres=64)


@query("X12_clinical_summary", f"""WITH {OBSERVATIONS} SELECT patient, status, string_agg(coalesce(CASE WHEN node <> 'view' THEN upper(node) END, node), ',' ORDER BY observed_at) AS items FROM obs WHERE obs_id < 3000 GROUP BY ALL""")
def x12(spark, d):
    labels = spark.createDataFrame([(n, n.upper()) for n in ("click", "error", "purchase", "signup")], "node string, label string")
    o = observations(spark, d).where("obs_id < 3000").join(F.broadcast(labels), "node", "left")  # a vocabulary
    rows = F.sort_array(F.collect_list(F.struct("observed_at", F.coalesce("label", "node").alias("item"))))
    return o.groupBy("patient", "status").agg(F.array_join(F.transform(rows, lambda x: x["item"]), ",").alias("items"))


@query("X13_visit_summary", f"""WITH {OBSERVATIONS}, l AS (SELECT patient, node, max_by(status, observed_at) AS status FROM obs WHERE status IN ('POSITIVE', 'NEGATIVE') GROUP BY ALL)
  SELECT patient, coalesce(string_agg(node, ',' ORDER BY node) FILTER (status = 'POSITIVE'), '') AS active, coalesce(string_agg(node, ',' ORDER BY node) FILTER (status = 'NEGATIVE'), '') AS resolved, coalesce(bool_or(node = 'error') FILTER (status = 'POSITIVE'), false) AS urgent FROM l GROUP BY 1""")
def x13(spark, d):
    last = observations(spark, d).where("status in ('POSITIVE', 'NEGATIVE')").groupBy("patient", "node").agg(F.max_by("status", F.struct("observed_at", "obs_id")).alias("status"))
    pick = lambda s: F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") == s, F.col("node")))), ",")
    return last.groupBy("patient").agg(pick("POSITIVE").alias("active"), pick("NEGATIVE").alias("resolved"), F.bool_or((F.col("status") == "POSITIVE") & (F.col("node") == "error")).alias("urgent"))


@query("X14_fact_candidate_rules", """WITH f AS (SELECT p_partkey AS id, p_brand AS k, p_type AS t, p_size AS n FROM part WHERE p_partkey < 1000), c AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.t = b.t AND a.n <> b.n THEN 'R1_CONFLICT' WHEN a.t = b.t THEN 'R2_SAME' WHEN abs(a.n - b.n) <= 1 THEN 'R3_NEAR' END AS rule FROM f a JOIN f b ON a.k = b.k AND a.id < b.id)
  SELECT rule, use, count(*) AS n FROM c CROSS JOIN (VALUES ('all'), ('strict')) u(use) WHERE rule IS NOT NULL AND (use = 'all' OR rule = 'R2_SAME') GROUP BY ALL""")
def x14(spark, d):
    f = table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size").where("p_partkey < 1000")
    a, b = (f.select(F.col("p_partkey").alias(x), F.col("p_brand").alias("k"), F.col("p_type").alias(f"t{x}"), F.col("p_size").alias(f"n{x}")) for x in "ab")
    rule = F.when((F.col("ta") == F.col("tb")) & (F.col("na") != F.col("nb")), "R1_CONFLICT").when(F.col("ta") == F.col("tb"), "R2_SAME").when(F.abs(F.col("na") - F.col("nb")) <= 1, "R3_NEAR")
    c = a.join(b, "k").where("a < b").select(rule.alias("rule")).where("rule is not null")
    uses = F.when(F.col("rule") == "R2_SAME", F.array(F.lit("all"), F.lit("strict"))).otherwise(F.array(F.lit("all")))
    return c.groupBy("rule").agg(F.count("*").alias("n")).select("rule", F.explode(uses).alias("use"), "n")


@query("X15_composite_rules", f"""WITH {TOKENS} SELECT case_id, bool_or(value = 'A') AND bool_or(value = 'O') AS both, bool_or(value = 'R') AND NOT bool_or(value = 'V_4') AS excluded, count(*) FILTER (code = 'E_3') >= 3 AS many FROM tokens GROUP BY 1""")
def x15(spark, d):
    v = F.collect_set("value")
    t = tokens(spark, d).groupBy("case_id").agg(v.alias("v"), F.count_if(F.col("code") == "E_3").alias("n"))
    has = lambda x: F.array_contains("v", x)
    return t.select("case_id", (has("A") & has("O")).alias("both"), (has("R") & ~has("V_4")).alias("excluded"), (F.col("n") >= 3).alias("many"))


@query("F46_sentence_split", f"WITH {SENTENCES} SELECT conv_id, turn, sentence_no, sentence FROM sen")
def f46(spark, d):
    return X.sentences(table(spark, d, "conversations", "conv_id", "turn", "text"), ["conv_id", "turn"], "text")


@query("F47_text_repair_chain", "SELECT event_id, event_type || ' for 3 days at ' || event_id % 10 || '/10' AS repaired FROM events")
def f47(spark, d):
    raw = F.concat(F.upper("event_type"), F.lit("  for three days at"), F.col("event_id") % 10, F.lit(" out of ten..."))
    steps = [(r"\bthree\b", "3"), (r"\bten\b", "10"), (r"(?<=[a-z])(?=\d)", " "), (r"(\d+) out of (\d+)", "$1/$2"), (r"[.]+$", ""), (r"\s+", " ")]
    t = F.lower(raw)
    for pattern, by in steps:
        t = F.regexp_replace(t, pattern, by)
    return table(spark, d, "events", "event_id", "event_type").select("event_id", F.trim(t).alias("repaired"))


@query("C18_nearest_leakage_neighbour")
def c18(spark, d):
    """The most similar training name of every held-out name, among names that share a word."""
    p = table(spark, d, "part", "p_partkey", "p_name").groupBy("p_name").agg(F.min("p_partkey").alias("id")).withColumn("w", F.explode(F.split("p_name", " ")))
    test = p.where("id % 5 = 0").select(F.col("id").alias("test_id"), F.col("p_name").alias("a"), "w")
    pairs = test.join(p.where("id % 5 <> 0").select("id", F.col("p_name").alias("b"), "w"), "w").select("test_id", "a", "id", "b").distinct()
    best = X.matching_ratio(pairs, "a", "b").groupBy("test_id").agg(F.max_by(F.struct("id", "ratio"), F.struct("ratio", "id")).alias("x"))
    return best.select("test_id", "x.id", "x.ratio")


@query("C19_resolution_linking", f"""WITH {OBSERVATIONS}, cue AS (SELECT patient, observed_at AS t, obs_id FROM obs WHERE node = 'purchase' AND status = 'POSITIVE')
  SELECT c.obs_id, max_by(o.obs_id, o.observed_at) AS resolves FROM cue c JOIN obs o ON o.patient = c.patient AND o.node = 'error' AND o.status = 'POSITIVE' AND o.observed_at < c.t GROUP BY 1""")
def c19(spark, d):
    # The nearest mention before a cue, by one running window over both; mentions of the same time are not before it.
    o = observations(spark, d).where("status = 'POSITIVE' and node in ('purchase', 'error')")
    last = F.max(F.when(F.col("node") == "error", F.struct("observed_at", "obs_id"))).over(Window.partitionBy("patient").orderBy(micros("observed_at")).rangeBetween(Window.unboundedPreceding, -1))
    return o.withColumn("resolves", last["obs_id"]).where("node = 'purchase' and resolves is not null").select("obs_id", "resolves")


@query("C21_start_planner", f"""WITH {TOKENS}, s AS (SELECT case_id, list(DISTINCT code) AS known FROM tokens WHERE value IN ('A', 'V_0', 'V_1', 'F') GROUP BY 1)
  SELECT case_id, CASE WHEN len(known) >= 2 THEN 'READY' WHEN len(known) = 1 THEN 'ASK' ELSE 'INCOMPLETE' END AS state, list_filter(['E_2', 'E_1', 'E_3', 'E_4'], lambda q: NOT list_contains(known, q))[1] AS next FROM s""")
def c21(spark, d):
    s = tokens(spark, d).where(F.col("value").isin("A", "V_0", "V_1", "F")).groupBy("case_id").agg(F.collect_set("code").alias("known"))
    order = F.array(*map(F.lit, ("E_2", "E_1", "E_3", "E_4")))
    state = F.when(F.size("known") >= 2, "READY").when(F.size("known") == 1, "ASK").otherwise("INCOMPLETE")
    return s.select("case_id", state.alias("state"), F.get(F.array_except(order, "known"), F.lit(0)).alias("next"))
