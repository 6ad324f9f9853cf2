"""Assertions as tables of violations; an empty table is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outside_vocabulary(df: DataFrame, vocabulary: DataFrame, word: str) -> DataFrame:
    """(path, value) of the leaves of flat rows whose value is not in the vocabulary."""
    leaves = df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("path", "value"))
    return leaves.where("value is not null").distinct().join(vocabulary.select(F.col(word).alias("value")), "value", "left_anti").select("path", "value")


def dangling(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key the target lacks; null keys are no violation."""
    return df.where(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias(key)), key, "left_anti")


def disagreeing(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, n) of keys whose rows differ in the fields (functional dependency)."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*fields)).alias("n")).where("n > 1")


def changed_cardinality(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_before, n_after) where a join has lost or multiplied rows."""
    n = before.groupBy(*keys).agg(F.count("*").alias("n_before")).join(after.groupBy(*keys).agg(F.count("*").alias("n_after")), keys, "full").na.fill(0)
    return n.where("n_before <> n_after")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def largest_gap(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n, gap): rows compared and the largest difference of a value that both sides compute."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return j.agg(F.count("*").alias("n"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("gap"))


def row_digest(df: DataFrame) -> DataFrame:
    """(n, digest): a SHA-256 over the sorted SHA-256 prefixes' counts, so that order plays no part."""
    h = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    part = h.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"))
    return part.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "n", "s"))), lambda x: F.concat_ws(":", x["p"], x["n"].cast("string"), x["s"].cast("string"))), ","), 256).alias("digest"))


def alias_violations(aliases: DataFrame, catalogue: DataFrame, statuses: tuple[str, ...], excluded: tuple[str, ...] = (), kinds: tuple[str, ...] = ("noun", "phrase"), macros: dict[str, str] | None = None) -> DataFrame:
    """(id, rule) of every broken rule of an alias table (id, evidence_id, pattern, kind, allow, status).

    An evidence must be in the catalogue (evidence_id, data_type), binary (`B`)
    and not excluded; a pattern must not be empty, keep an unknown {MACRO} or
    match the empty text; kind, allow and status must be of the given values (null
    kind, allow and status are allowed); ids occur once.  A pattern that is no
    regular expression raises an error.
    """
    pattern = F.coalesce("pattern", F.lit(""))
    for name, value in (macros or {}).items():
        pattern = F.replace(pattern, F.lit("{" + name + "}"), F.lit(value))
    known = catalogue.select("evidence_id", F.col("data_type").alias("_type"), F.lit(True).alias("_known")).dropDuplicates(["evidence_id"])
    a = aliases.withColumn("pattern", pattern).join(known, "evidence_id", "left")
    macro = F.col("pattern").rlike(r"\{[A-Z]+\}")
    allowed = F.array(*map(F.lit, statuses))
    broken = {
        "UNKNOWN_EVIDENCE": F.col("_known").isNull(),
        "EXCLUDED_EVIDENCE": F.col("evidence_id").isin(*excluded),
        "NOT_BINARY": F.col("_known") & ~F.col("_type").eqNullSafe("B"),
        "EMPTY_PATTERN": F.col("pattern") == "",
        "UNRESOLVED_MACRO": macro,
        "MATCHES_EMPTY": F.when((F.col("pattern") == "") | macro, False).otherwise(F.regexp_like(F.lit(""), F.col("pattern"))),
        "BAD_KIND": ~F.col("kind").isin(*kinds),
        "BAD_ALLOW": (F.size("allow") == 0) | (F.size(F.array_except("allow", allowed)) > 0),
        "BAD_STATUS": ~F.col("status").isin(*statuses),
    }
    rules = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in broken.items()]), lambda r: r.isNotNull())
    twice = aliases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("DUPLICATE_ID").alias("rule"))
    return a.select("id", F.explode(rules).alias("rule")).unionByName(twice).distinct()


def policy_violations(policy: DataFrame, supported: DataFrame) -> DataFrame:
    """(evidence_id, rule): a policy (evidence_id, allowed, reason) must tell each supported evidence exactly once, with a decision and a reason."""
    p = policy.groupBy("evidence_id").agg(F.count("*").alias("_n"), F.bool_and(F.col("allowed").isNotNull() & (F.coalesce("reason", F.lit("")) != "")).alias("_told"))
    j = p.join(supported.select("evidence_id", F.lit(True).alias("_s")).distinct(), "evidence_id", "full")
    broken = {"MISSING": F.col("_n").isNull(), "EXTRA": F.col("_s").isNull(), "DUPLICATE": F.col("_n") > 1, "NO_REASON": ~F.col("_told")}
    return j.select("evidence_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in broken.items()]), lambda r: r.isNotNull())).alias("rule"))
