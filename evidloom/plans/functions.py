"""Queries F1 to F35, F43 to F48: scalar functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.aggregates import mean_at_least
from ..operators.topk import top_k
from ..registry import query
from .fixtures import table


@query("F1_list_literal", "SELECT s_suppkey, CAST(len(x) AS INT) AS n, x[2] AS second FROM (SELECT s_suppkey, ['E_' || s_suppkey, 'E_' || s_nationkey || '_@_V_1'] AS x FROM supplier)")
def f1(spark, d):
    text = F.format_string("['E_%d', 'E_%d_@_V_1']", "s_suppkey", "s_nationkey")
    x = S.list_literal(text)
    return table(spark, d, "supplier", "s_suppkey", "s_nationkey").select("s_suppkey", F.size(x).alias("n"), x[1].alias("second"))


@query("F2_token_partition", """SELECT p_partkey, split_part(t, '_@_', 1) AS code, CASE WHEN contains(t, '_@_') THEN split_part(t, '_@_', 2) END AS value FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'E_' || p_size ELSE 'E_' || p_size || '_@_' || p_brand END AS t FROM part)""")
def f2(spark, d):
    t = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("E_"), "p_size")).otherwise(F.concat(F.lit("E_"), "p_size", F.lit("_@_"), "p_brand"))
    return table(spark, d, "part", "p_partkey", "p_size", "p_brand").select("p_partkey", S.token_code(t).alias("code"), S.token_value(t).alias("value"))


@query("F3_numeric_suffix", "SELECT p_brand, CAST(substr(p_brand, 7) AS INT) AS n, count(*) AS parts FROM part GROUP BY ALL ORDER BY n")
def f3(spark, d):
    return table(spark, d, "part", "p_brand").groupBy("p_brand", F.expr("cast(substr(p_brand, 7) as int)").alias("n")).agg(F.count("*").alias("parts")).orderBy("n")


@query("F4_age_band", "SELECT c_custkey, CAST(greatest(least(floor((c_custkey % 120) / 10.0), 9), 0) AS BIGINT) AS band FROM customer")
def f4(spark, d):
    return table(spark, d, "customer", "c_custkey").select("c_custkey", S.age_band(F.col("c_custkey") % 120).alias("band"))


@query("F5_hash_split", "SELECT o_orderkey, CAST(('0x' || substr(sha256('seed|' || o_orderkey), 1, 8)) AS BIGINT) % 5 AS split FROM orders")
def f5(spark, d):
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", (S.hash_number(F.lit("seed"), F.col("o_orderkey").cast("string")) % 5).alias("split"))


@query("F6_full_hash_modulo", "SELECT c_custkey, list_reduce(list_transform(string_split(sha256(CAST(c_custkey AS VARCHAR)), ''), lambda x: CAST(('0x' || x) AS BIGINT)), lambda a, x: (a * 16 + x) % 7, 0::BIGINT) AS fold FROM customer")
def f6(spark, d):
    return table(spark, d, "customer", "c_custkey").select("c_custkey", S.full_hash_modulo(F.col("c_custkey").cast("string"), 7).alias("fold"))


@query("F7_unit_hash", "SELECT o_orderkey, CAST(('0x' || substr(sha256('u|' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM orders")
def f7(spark, d):
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", (S.hash_number(F.lit("u"), F.col("o_orderkey").cast("string")) / 4294967296.0).alias("u"))


@query("F8_id_normalization", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, upper(replace(replace(p_brand || '.' || p_type, '.', ''), ' ', '')) AS code FROM part")
def f8(spark, d):
    return table(spark, d, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", S.plain_id(F.concat(F.lit(" "), "p_partkey", F.lit(".0 "))).alias("id"), S.plain_code(F.concat("p_brand", F.lit(". "), "p_type")).alias("code"))


@query("F9_timestamp_parse", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def f9(spark, d):
    text = F.when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".123 UTC")))
    return table(spark, d, "events", "event_id", "ts").select("event_id", S.timestamp_of(text).cast("timestamp_ntz").alias("at"))


@query("F10_hours_between", "SELECT l_orderkey, l_linenumber, round(epoch_us(l_shipdate - o_orderdate) / 3.6e9, 6) AS hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def f10(spark, d):
    j = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").join(table(spark, d, "orders", "o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.round(S.hours_between(F.col("l_shipdate"), F.col("o_orderdate")), 6).alias("hours"))


@query("F11_anchored_age", "SELECT o_orderkey, CAST(20 + o_custkey % 50 + year(o_orderdate) - 1995 AS BIGINT) AS age FROM orders")
def f11(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", (20 + F.col("o_custkey") % 50 + F.year("o_orderdate") - 1995).alias("age"))


RAW_VALUE = "CASE event_id % 6 WHEN 0 THEN '<' || value WHEN 1 THEN '>=' || value WHEN 2 THEN 'nan' WHEN 3 THEN '' WHEN 4 THEN 'inf' ELSE CAST(value AS VARCHAR) END"


def raw_values(spark, d):
    v, k = F.col("value").cast("string"), F.col("event_id") % 6
    text = F.when(k == 0, F.concat(F.lit("<"), v)).when(k == 1, F.concat(F.lit(">="), v)).when(k == 2, "nan").when(k == 3, "").when(k == 4, "inf").otherwise(v)
    return table(spark, d, "events", "event_id", "value").where("value < 1000").select("event_id", text.alias("t"))


@query("F12_finite_parse", "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN value END AS x FROM events WHERE value < 1000")
def f12(spark, d):
    return raw_values(spark, d).select("event_id", S.finite(F.col("t")).alias("x"))


@query("F13_censored_parse", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'BELOW' WHEN 1 THEN 'ABOVE' WHEN 5 THEN 'EXACT' END AS kind, CASE WHEN event_id % 6 IN (0, 1, 5) THEN value END AS bound, CASE event_id % 6 WHEN 0 THEN value - 1e12 WHEN 1 THEN value + 1e12 WHEN 5 THEN value END AS rank_value FROM events WHERE value < 1000")
def f13(spark, d):
    return raw_values(spark, d).select("event_id", S.censored(F.col("t")).alias("c")).select("event_id", "c.*")


@query("F14_unit_normalization", "SELECT p_partkey, lower(replace(p_type || ' / ' || p_name, ' ', '')) AS unit FROM part")
def f14(spark, d):
    return table(spark, d, "part", "p_partkey", "p_type", "p_name").select("p_partkey", S.unit_name(F.concat_ws(" / ", "p_type", "p_name")).alias("unit"))


@query("F15_frequency_parse", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 0.8 WHEN 1 THEN s_suppkey / 400.0 WHEN 2 THEN (s_suppkey % 100) / 100.0 END::DOUBLE AS lo, CASE s_suppkey % 4 WHEN 0 THEN 0.99 WHEN 1 THEN s_suppkey / 400.0 WHEN 2 THEN (s_suppkey % 100) / 100.0 END::DOUBLE AS hi FROM supplier""")
def f15(spark, d):
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, "frequent").when(k % 4 == 1, F.concat(k, F.lit("/400"))).when(k % 4 == 2, F.concat(k % 100, F.lit("%"))).otherwise("?")
    return table(spark, d, "supplier", "s_suppkey").select("s_suppkey", S.frequency_range(text, {"frequent": (0.8, 0.99), "rare": (0.01, 0.04)}).alias("r")).select("s_suppkey", "r.lo", "r.hi")


@query("F16_text_normalizer", "SELECT p_partkey, lower(replace(p_brand, '#', ' ')) || ' ' || p_name AS t FROM part")
def f16(spark, d):
    return table(spark, d, "part", "p_partkey", "p_brand", "p_name").select("p_partkey", S.plain_text(F.concat("p_brand", F.lit(" -- "), F.upper("p_name"), F.lit(" (finding)"))).alias("t"))


@query("F17_light_stemmer", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name || 's', ' '), lambda w: w <> 'old'), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(ing|es|s)$', '') ELSE w END), ' ') AS stems FROM part")
def f17(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.array_join(S.stems(F.concat("p_name", F.lit("s")), ["old", "the"]), " ").alias("stems"))


@query("F18_spelling_variants", "SELECT DISTINCT p_name, unnest([p_name, replace(p_name, ' ', ''), replace(p_name, ' ', '-')]) AS variant FROM part")
def f18(spark, d):
    n = table(spark, d, "part", "p_name").distinct()
    return n.select("p_name", F.explode(F.array_union(S.spelling_variants(F.col("p_name")), F.array(F.replace("p_name", F.lit(" "), F.lit("-"))))).alias("variant"))


@query("F19_unicode_nfc")
def f19(spark, d):
    """No built-in normalises Unicode, so Arrow batches do."""
    import unicodedata

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_chars": [len(" ".join(unicodedata.normalize("NFC", t or "").split())) for t in b["text"]]})

    return table(spark, d, "documents", "doc_id", "text").mapInPandas(run, "doc_id long, n_chars long")


# Names with none, one, two or three particles, and words that are nothing but particles.
ENDINGS = ("", "은", "에서", "에게는", "까지만의", "으로는")
ENDED = "CASE WHEN p_partkey % 7 = 6 THEN '' ELSE p_name END || ' ' || ['', '은', '에서', '에게는', '까지만의', '으로는'][CAST(p_partkey % 6 + 1 AS INT)]"


@query("F20_particle_stripping", f"""WITH a AS (SELECT p_partkey, regexp_replace({ENDED}, '\\s+', '', 'g') AS w FROM part), b AS (SELECT *, regexp_replace(w, '({'|'.join(S.PARTICLES)})$', '') AS s FROM a),
  c AS (SELECT p_partkey, CASE WHEN s = '' THEN w ELSE s END AS w FROM b), e AS (SELECT *, regexp_replace(w, '({'|'.join(S.PARTICLES)})$', '') AS s FROM c) SELECT p_partkey, CASE WHEN s = '' THEN w ELSE s END AS stem FROM e""")
def f20(spark, d):
    word = F.concat(F.when(F.col("p_partkey") % 7 == 6, "").otherwise(F.col("p_name")), F.lit(" "), F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", S.without_particles(word).alias("stem"))


GRAMS = "g AS (SELECT DISTINCT p_name, list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2))) AS g FROM part)"


@query("F21_character_bigrams", f"WITH {GRAMS} SELECT p_name, array_to_string(list_sort(g), ',') AS grams FROM g")
def f21(spark, d):
    return table(spark, d, "part", "p_name").distinct().select("p_name", F.array_join(F.sort_array(S.ngrams(F.col("p_name"), 2)), ",").alias("grams"))


@query("F22_jaccard", f"WITH {GRAMS} SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 8) AS jaccard, round(len(list_intersect(a.g, b.g)) / len(a.g), 8) AS containment FROM g a JOIN g b ON substr(a.p_name, 1, 2) = substr(b.p_name, 1, 2)")
def f22(spark, d):
    g = table(spark, d, "part", "p_name").distinct().select("p_name", S.ngrams(F.col("p_name"), 2).alias("g"), F.substring("p_name", 1, 2).alias("k"))
    j = g.select(F.col("p_name").alias("a"), F.col("g").alias("ga"), "k").join(g.select(F.col("p_name").alias("b"), F.col("g").alias("gb"), "k"), "k")
    return j.select("a", "b", F.round(S.jaccard(F.col("ga"), F.col("gb")), 8).alias("jaccard"), F.round(S.containment(F.col("ga"), F.col("gb")), 8).alias("containment"))


def matching_ratios(pairs):
    """(a, b, ratio) of Ratcliff-Obershelp; no built-in has it, so Arrow batches do."""
    import difflib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ratio=[difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(b["a"], b["b"], strict=True)])

    return pairs.mapInPandas(run, "a string, b string, ratio double")


@query("F23_matching_ratio")
def f23(spark, d):
    """Ratcliff-Obershelp ratio of names in one block."""
    n = table(spark, d, "part", "p_name").distinct().withColumn("k", F.substring("p_name", 1, 2))
    return matching_ratios(n.withColumnRenamed("p_name", "a").join(n.withColumnRenamed("p_name", "b"), "k").where("a < b").select("a", "b"))


@query("F24_tfidf_cosine", f"""WITH {GRAMS}, t AS (SELECT p_name, unnest(g) AS x FROM g), n AS (SELECT count(*) AS n FROM g), i AS (SELECT x, ln((1.0 + n) / (1 + count(*))) + 1 AS idf FROM t CROSS JOIN n GROUP BY x, n),
  w AS (SELECT p_name, x, idf / sqrt(sum(idf * idf) OVER (PARTITION BY p_name)) AS w FROM t JOIN i USING (x)),
  s AS (SELECT a.p_name AS a, b.p_name AS b, sum(a.w * b.w) AS c FROM w a JOIN w b USING (x) WHERE a.p_name <> b.p_name GROUP BY ALL)
  SELECT a, b, round(c, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) <= 3""")
def f24(spark, d):
    t = table(spark, d, "part", "p_name").distinct().select("p_name", F.explode(S.ngrams(F.col("p_name"), 2)).alias("x"))
    n = t.select(F.count_distinct("p_name").alias("n"))
    idf = t.groupBy("x").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("x", (F.ln((1.0 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    w = t.join(idf, "x")
    norm = w.groupBy("p_name").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    w = w.join(norm, "p_name").select("p_name", "x", (F.col("idf") / F.col("norm")).alias("w"))
    s = w.select(F.col("p_name").alias("a"), "x", F.col("w").alias("wa")).join(w.select(F.col("p_name").alias("b"), "x", F.col("w").alias("wb")), "x").where("a <> b")
    s = s.groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("cosine"))
    return top_k(s, ["a"], [F.desc("cosine"), F.asc("b")], 3)


@query("F25_blended_grade", """SELECT p_partkey, round(0.7 * (p_size / 50.0) + 0.3 * (p_partkey % 10) / 10.0, 8) AS score, CASE WHEN 0.7 * (p_size / 50.0) + 0.3 * (p_partkey % 10) / 10.0 >= 0.7 THEN 'A' WHEN 0.7 * (p_size / 50.0) + 0.3 * (p_partkey % 10) / 10.0 >= 0.4 THEN 'B' ELSE 'C' END AS grade FROM part""")
def f25(spark, d):
    s = 0.7 * (F.col("p_size") / 50.0) + 0.3 * (F.col("p_partkey") % 10) / 10.0
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", F.round(s, 8).alias("score"), F.when(s >= 0.7, "A").when(s >= 0.4, "B").otherwise("C").alias("grade"))


@query("F26_edit_distance", "SELECT DISTINCT p_name, CAST(levenshtein(p_name, 'red widget') AS INT) AS distance FROM part")
def f26(spark, d):
    return table(spark, d, "part", "p_name").distinct().select("p_name", F.levenshtein("p_name", F.lit("red widget")).alias("distance"))


@query("F27_set_token_match", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'bolt', 'gear'])) >= 2 OR (len(list_intersect(string_split(p_name, ' '), ['red', 'bolt', 'gear'])) > 0 AND len(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(['red', 'bolt', 'gear'], x))) = 0) AS hit FROM part")
def f27(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", S.set_token_match(F.split("p_name", " "), F.array(F.lit("red"), F.lit("bolt"), F.lit("gear"))).alias("hit"))


# The tables' prose has hardly a marker, so each turn ends with one of seven sentences.
CLOSINGS = ("", " It is required and should be performed.", " It may be considered.", " Consider it; first-line care is recommended.", " Optional, but it can help.", " Cannot say, mustard only.", " An option that MUST stay.")
FOUND = "list_sort(list_distinct(flatten([{}])))"


@query("F28_wording_strength", f"""WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '') || [{', '.join(f"'{c}'" for c in CLOSINGS)}][CAST((conv_id + turn) % 7 + 1 AS INT)]) AS t FROM conversations),
  m AS (SELECT conv_id, turn, {FOUND.format(', '.join(f"regexp_extract_all(t, '{p}')" for p in S.STRONG))} AS s, {FOUND.format(', '.join(f"regexp_extract_all(t, '{p}')" for p in S.PERMISSIVE))} AS p FROM t)
  SELECT conv_id, turn, CASE WHEN len(s) > 0 AND len(p) > 0 THEN 'MIXED' WHEN len(s) > 0 THEN 'STRONG' WHEN len(p) > 0 THEN 'PERMISSIVE' ELSE 'UNMARKED' END AS strength, array_to_string(s || p, ',') AS markers FROM m""")
def f28(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, CLOSINGS)), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int")))
    w = table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", S.wording(text).alias("w"))
    return w.select("conv_id", "turn", "w.strength", F.array_join("w.markers", ",").alias("markers"))


@query("F29_quote_verification", "SELECT p_partkey, contains(p_name, split_part(p_name, ' ', 2)) AND contains(p_name, 'e') AS quoted FROM part")
def f29(spark, d):
    quote = F.concat(F.substring_index("p_name", " ", -1), F.lit("... e"))
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", S.quoted_in(quote, F.col("p_name")).alias("quoted"))


@query("F30_severity_number", "SELECT p_partkey, (p_partkey % 11) / 10.0::DOUBLE AS grade FROM part")
def f30(spark, d):
    text = F.concat((F.col("p_size") % 11).cast("string"), F.lit("/10점 → "), (F.col("p_partkey") % 11).cast("string"), F.lit("/10점"))
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", S.severity(text).alias("grade"))


@query("F31_relative_onset", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) - 1 WHEN 1 THEN CAST(ts AS DATE) - CAST(event_id % 9 AS INT) ELSE make_date(year(ts), month(ts), 1) END AS onset FROM events""")
def f31(spark, d):
    day, k = F.to_date("ts"), F.col("event_id") % 3
    phrase = F.when(k == 0, "yesterday").when(k == 1, F.concat((F.col("event_id") % 9).cast("string"), F.lit(" days ago"))).otherwise("start of month")
    e = table(spark, d, "events", "event_id", "ts").withColumn("phrase", phrase)
    ago = F.regexp_extract("phrase", r"^(\d+) days ago$", 1).try_cast("int")
    onset = F.when(F.col("phrase") == "yesterday", F.date_sub(day, 1)).when(ago.isNotNull(), F.date_sub(day, ago)).when(F.col("phrase") == "start of month", F.trunc(day, "month"))
    return e.select("event_id", onset.alias("onset"))


@query("F32_month_grid", """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders) SELECT m AS month, CAST(unnest(generate_series(m - CAST(dayofweek(m) AS INT), last_day(m) + (6 - CAST(dayofweek(last_day(m)) AS INT)), INTERVAL 1 DAY)) AS DATE) AS day FROM m""")
def f32(spark, d):
    m = table(spark, d, "orders", "o_orderdate").select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    return m.select("month", F.explode(S.month_grid(F.col("month"))).alias("day"))


@query("F33_nearest_match", "SELECT p_partkey, CASE WHEN min(abs(instr(p_name, c) - 4)) <= 3 THEN arg_min(c, abs(instr(p_name, c) - 4) * 100 + ascii(c)) END AS nearest FROM part CROSS JOIN (VALUES ('e'), ('o'), ('i'), ('l')) v(c) WHERE contains(p_name, c) GROUP BY 1")
def f33(spark, d):
    hits = F.filter(F.transform(F.array(*map(F.lit, "eoil")), lambda c: F.struct(F.abs(F.instr(F.col("p_name"), c) - 4).alias("gap"), c.alias("c"), F.instr(F.col("p_name"), c).alias("at"))), lambda x: x["at"] > 0)
    p = table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.array_min(hits).alias("best"))
    return p.where("best is not null").select("p_partkey", F.when(F.col("best.gap") <= 3, F.col("best.c")).alias("nearest"))


@query("F34_personal_data_flags", r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'email' END, CASE WHEN regexp_matches(text, '\b\d{2,3}-\d{3,4}-\d{4}\b') THEN 'phone' END,
  CASE WHEN regexp_matches(text, 'https?://') THEN 'url' END, CASE WHEN regexp_matches(text, '\b\d{6}-[1-4]\d{6}\b') THEN 'national_id' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents""")
def f34(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(S.personal_data_flags(F.col("text")), ",").alias("flags"))


@query("F35_bio_spans", """WITH b AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'B' WHEN 'assistant' THEN 'I' ELSE 'O' END AS tag FROM conversations),
  g AS (SELECT *, sum(CASE WHEN tag <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM b)
  SELECT conv_id, min(turn) AS start, max(turn) + 1 AS "end" FROM g GROUP BY conv_id, k HAVING bool_or(tag = 'B')""")
def f35(spark, d):
    tag = F.when(F.col("role") == "user", "B").when(F.col("role") == "assistant", "I").otherwise("O")
    b = table(spark, d, "conversations", "conv_id", "turn", "role").withColumn("tag", tag)
    k = F.sum((F.col("tag") != "I").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    spans = b.withColumn("k", k).groupBy("conv_id", "k").agg(F.min("turn").alias("start"), (F.max("turn") + 1).alias("end"), F.bool_or(F.col("tag") == "B").alias("any"))
    return spans.where("any").select("conv_id", "start", "end")


@query("F43_adoption_chain", """WITH s AS (SELECT l_suppkey, l_returnflag, avg(l_discount) AS m FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, min(CASE WHEN m >= 0.048 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_returnflag ROWS UNBOUNDED PRECEDING) = 1 AS adopted FROM s""")
def f43(spark, d):
    """Means at the threshold occur, and there the side hangs on the order in which doubles are added: that of the table."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_discount", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    s = mean_at_least(li, ["l_suppkey", "l_returnflag"], "l_discount", 0.048, "at", "high")
    w = Window.partitionBy("l_suppkey").orderBy(F.asc_nulls_last("l_returnflag")).rowsBetween(Window.unboundedPreceding, 0)
    return s.select("l_suppkey", "l_returnflag", F.bool_and("high").over(w).alias("adopted"))


@query("F44_answer_validation", "SELECT p_partkey, CASE WHEN p_type NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL') THEN 'UNKNOWN_TYPE' WHEN p_size > 45 THEN 'OUT_OF_RANGE' WHEN p_size % 2 = 1 AND p_type = 'PROMO' THEN 'WRONG_VALUE' ELSE 'OK' END AS code FROM part")
def f44(spark, d):
    code = F.when(~F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"), "UNKNOWN_TYPE").when(F.col("p_size") > 45, "OUT_OF_RANGE").when((F.col("p_size") % 2 == 1) & (F.col("p_type") == "PROMO"), "WRONG_VALUE").otherwise("OK")
    return table(spark, d, "part", "p_partkey", "p_type", "p_size").select("p_partkey", code.alias("code"))


@query("F48_withheld_percent", "SELECT user_id, CASE WHEN count(*) >= 60 THEN printf('%.1f%%', 100.0 * count(*) FILTER (event_type = 'error') / count(*)) ELSE 'WITHHELD' END AS share FROM events GROUP BY 1")
def f48(spark, d):
    c = table(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    return c.select("user_id", S.withheld_percent(F.col("k"), F.col("n"), 60).alias("share"))
