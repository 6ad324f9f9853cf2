"""Queries of clause scope and of similar turns over whole conversations; the SQL finds scopes by windows over words.

The driver's conversations are invented prose, so their function words stand in
for mentions and cues.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clauses as C
from ..operators import texts as X
from ..operators.setjoin import set_classes, similar_sets
from ..registry import query
from .fixtures import table
from .functions import GRAMS

MENTIONED = {"E_1": ("th", "re", "tion"), "E_2": ("es", "er", "la"), "E_3": ("die", "un", "den", "ing"), "E_4": ("it", "ha", "le")}
CUES = {
    "persists": "^(are|sich|thing)$", "before": "^(nicht|no|not|pas|sin|with|mit)$", "after": "^(was|est|ist|que)$", "partly": "^(as|zu)$", "hedges": "^(this|für|pour)$", "conditions": "^(that|des)$",
    "improved": "^(at|el)$", "past": "^(from|von|avec)$", "others": "^(he|elle|by)$", "loosely": "^(on|auf|en)$", "lists": "^(or|oder|ou|be)$", "particles": "^(of|to|in|a|de|der|the)$",
}
LEXICON = C.Lexicon(MENTIONED, **CUES, opens="^(and|und|et|y)$", endings="(keit|heit|ment|ion)$", history=("E_4",))

_CODE = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in words)}) THEN '{code}'" for code, words in MENTIONED.items()) + " END"
_ROLE = "CASE WHEN w = '' THEN 'particles' WHEN code IS NOT NULL THEN 'mention' " + " ".join(f"WHEN regexp_matches(w, '{p}') THEN '{name}'" for name, p in CUES.items()) + " ELSE 'other' END"
_KEYS = "conv_id, turn, sentence_no"
#: Sentences by places, their words, and clauses: bounds are counted, mentions and their zones are numbered, all by windows over words.
SCOPES = rf"""parts AS (SELECT conv_id, turn, text, string_split_regex(text, '[.!?\n]') AS ps FROM conversations),
  sen AS (SELECT conv_id, turn, CAST(i - 1 AS INT) AS sentence_no, ps[i] AS sentence, CAST(coalesce(list_sum(list_transform(ps[1:i - 1], lambda p: length(p) + 1)), 0) AS INT) AS start, text FROM parts, range(1, 10000) r(i) WHERE i <= len(ps)),
  s AS (SELECT *, substr(text, start + length(sentence) + 1, 1) = '?' AS question, string_split_regex(sentence, '\s') AS ws FROM sen WHERE trim(sentence, ' ') <> ''),
  wd AS (SELECT {_KEYS}, start, question, i, ws[i] AS raw, CAST(coalesce(list_sum(list_transform(ws[1:i - 1], lambda p: length(p) + 1)), 0) AS INT) AS at_ FROM s, range(1, 10000) r(i) WHERE i <= len(ws)),
  w1 AS (SELECT *, regexp_replace(regexp_replace(lower(raw), '^[,;:()"'']+', ''), '[,;:()"'']+$', '') AS w FROM wd), w2 AS (SELECT *, {_CODE} AS code FROM w1),
  w3 AS (SELECT *, {_ROLE} AS role, regexp_matches(w, '^(and|und|et|y)$') AS word_opens, regexp_matches(w, '(keit|heit|ment|ion)$') AS ending, regexp_matches(raw, '[,;:]$') AS sign FROM w2),
  w4 AS (SELECT *, role IN ('mention', 'particles', 'lists', 'loosely') AS joins, max(CASE WHEN role = 'mention' THEN i END) OVER up AS m,
    coalesce(max(CASE WHEN role NOT IN ('mention', 'particles', 'lists', 'loosely') THEN i END) OVER up, 0) AS o, coalesce(max(CASE WHEN ending THEN i END) OVER below, 0) AS e FROM w3
    WINDOW up AS (PARTITION BY {_KEYS} ORDER BY i ROWS UNBOUNDED PRECEDING), below AS (PARTITION BY {_KEYS} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  w5 AS (SELECT *, sign AND NOT ending AND m IS NOT NULL AND o < m AND e < m AS listed FROM w4),
  w6 AS (SELECT *, (sign OR ending) AND NOT listed AS ends, word_opens OR (coalesce(lag(listed) OVER up, false) AND NOT joins) AS opens FROM w5 WINDOW up AS (PARTITION BY {_KEYS} ORDER BY i)),
  tok AS (SELECT *, CAST(sum(CAST(opens AS INT)) OVER up + coalesce(sum(CAST(ends AS INT)) OVER below, 0) AS INT) AS clause FROM w6
    WINDOW up AS (PARTITION BY {_KEYS} ORDER BY i ROWS UNBOUNDED PRECEDING), below AS (PARTITION BY {_KEYS} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_UP = f"(PARTITION BY {_KEYS}, clause ORDER BY i ROWS UNBOUNDED PRECEDING)"
#: Cues of each mention's zone, its own status, and what it inherits from the right.
STATUSES = f"""{SCOPES}, z AS (SELECT *, count(*) FILTER (role = 'mention') OVER {_UP} AS zone, count(*) FILTER (role = 'before') OVER {_UP} AS negs, count(*) FILTER (role = 'hedges') OVER {_UP} AS hs, count(*) FILTER (role = 'conditions') OVER {_UP} AS cs,
    count(*) FILTER (role = 'mention') OVER (PARTITION BY {_KEYS}, clause) AS zones FROM tok),
  g AS (SELECT {_KEYS}, clause, zone, any_value(start) AS start, any_value(question) AS question, min(at_) FILTER (role = 'mention') AS at_, min(code) FILTER (role = 'mention') AS code, min(negs) AS negs, max(negs) AS all_negs, max(hs) AS hs, max(cs) AS cs, any_value(zones) AS zones, min(i) AS i,
    count(*) FILTER (role = 'after') AS afters, bool_or(role = 'partly') AS partly, bool_or(role = 'improved') AS improved, bool_or(role = 'persists') AS persists, bool_and(joins) AND NOT bool_or(ends) AS bare, bool_or(role = 'loosely') AS loose FROM z WHERE zone > 0 GROUP BY ALL),
  n AS (SELECT *, negs + afters + CASE WHEN zone = zones THEN all_negs - negs ELSE 0 END AS negations, zone < zones AS more FROM g),
  own AS (SELECT *, CASE WHEN hs > 0 OR cs > 0 THEN 'UNCERTAIN' WHEN persists AND negations > 0 THEN 'POSITIVE' WHEN improved THEN 'UNCERTAIN' WHEN bare AND more AND negations = 0 AND loose THEN 'INHERIT_POSITIVE' WHEN bare AND more AND negations = 0 THEN 'INHERIT'
    WHEN negations = 0 THEN 'POSITIVE' WHEN negations = 1 AND NOT partly THEN 'NEGATIVE' ELSE 'UNCERTAIN' END AS own FROM n),
  final AS (SELECT *, first_value(CASE WHEN own NOT LIKE 'INHERIT%' THEN own END IGNORE NULLS) OVER down AS base, min(CASE WHEN own NOT LIKE 'INHERIT%' THEN i END) OVER down AS stop, min(CASE WHEN own = 'INHERIT_POSITIVE' THEN i END) OVER down AS loose_at FROM own
    WINDOW down AS (PARTITION BY {_KEYS} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  said AS (SELECT {_KEYS}, bool_or(role = 'past') AS past, bool_or(role = 'others') AS other FROM tok GROUP BY ALL),
  men AS (SELECT conv_id, turn, sentence_no, clause, start + at_ AS "at", code, CASE WHEN coalesce(loose_at, stop) < stop AND base <> 'POSITIVE' THEN 'UNKNOWN' ELSE base END AS status, CAST(negations AS INT) AS negations, past AND code <> 'E_4' AS past, other, question FROM final JOIN said USING ({_KEYS}))"""


def contexts(spark, d):
    return C.mention_contexts(table(spark, d, "conversations", "conv_id", "turn", "text"), ["conv_id", "turn"], "text", LEXICON)


@query("F45_negation_cascade", f"""WITH {STATUSES} SELECT conv_id, turn, "at", code, status, negations FROM men""")
def f45(spark, d):
    return contexts(spark, d).select("conv_id", "turn", "at", "code", "status", "negations")


@query("F46_clause_scope", rf"""WITH {SCOPES}, c AS (SELECT {_KEYS}, clause, min(start + at_) AS start, max(start + at_ + length(raw)) AS "end", any_value(start) AS begun, any_value(question) AS q FROM tok GROUP BY ALL)
  SELECT c.conv_id, c.turn, c.sentence_no, clause, c.start, c."end", trim(substr(text, c.start + 1, c."end" - c.start), ' ') AS words FROM c JOIN conversations v ON v.conv_id = c.conv_id AND v.turn = c.turn WHERE trim(substr(text, c.start + 1, c."end" - c.start), ' ') <> ''""")
def f46(spark, d):
    return C.clauses(table(spark, d, "conversations", "conv_id", "turn", "text"), ["conv_id", "turn"], "text", LEXICON)


@query("X7_mention_context", f"WITH {STATUSES} SELECT * FROM men")
def x7(spark, d):
    return contexts(spark, d)


@query("X7_turn_evidence", f"""WITH {STATUSES} SELECT conv_id, turn, code, min(status) AS status FROM men WHERE status IN ('POSITIVE', 'NEGATIVE') AND NOT past AND NOT other AND NOT question GROUP BY ALL HAVING min(status) = max(status)""")
def x7_evidence(spark, d):
    return C.evidence(contexts(spark, d), ["conv_id", "turn"])


#: Turns by their words, each once; of turns with equal words the first stands for all.
TURN_SETS = r"""w AS (SELECT conv_id * 1000 + turn AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-zà-ÿ]+'), lambda x: x <> ''))) AS ws FROM conversations), s AS (SELECT ws, min(id) AS id FROM w WHERE len(ws) > 0 GROUP BY 1)"""


def turn_words(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-zà-ÿ]+"), lambda x: x != "")
    return table(spark, d, "conversations", "conv_id", "turn", "text").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), words.alias("words"))


@query("F22_similar_turns", f"""WITH {TURN_SETS}, p AS (SELECT a.id AS a, b.id AS b, len(a.ws) AS n_a, len(b.ws) AS n_b, len(list_intersect(a.ws, b.ws)) AS n_both FROM s a JOIN s b ON a.id < b.id)
  SELECT a, b, CAST(n_a AS INT) AS n_a, CAST(n_b AS INT) AS n_b, CAST(n_both AS INT) AS n_both FROM p WHERE 100 * n_both >= 60 * (n_a + n_b - n_both)""")
def f22_turns(spark, d):
    """All pairs of turns whose words agree to 60 % or more."""
    return similar_sets(turn_words(spark, d), None, "id", "words", 60)


@query("F22_turn_classes", rf"WITH {TURN_SETS} SELECT w.id, s.id AS rep FROM w JOIN s USING (ws)")
def f22_classes(spark, d):
    """The turn that stands for each in the pairs."""
    return set_classes(turn_words(spark, d), "id", "words").select("id", "rep")


@query("F22_similar_names", f"""WITH {GRAMS}, p AS (SELECT a.p_name AS a, b.p_name AS b, len(a.g) AS n_a, len(b.g) AS n_b, len(list_intersect(a.g, b.g)) AS n_both FROM g a JOIN g b ON a.p_name < b.p_name)
  SELECT a, b, CAST(n_a AS INT) AS n_a, CAST(n_b AS INT) AS n_b, CAST(n_both AS INT) AS n_both FROM p WHERE 100 * n_both >= 50 * (n_a + n_b - n_both)""")
def f22_names(spark, d):
    """All pairs of names that share half of their letter pairs or more."""
    names = table(spark, d, "part", "p_name").distinct()
    return similar_sets(names.withColumn("g", S.ngrams(F.col("p_name"), 2)), None, "p_name", "g", 50)


@query("F23_windowed_best")
def f23_windowed(spark, d):
    """Each part's name against a longer text, the type, brand and name of the part after it."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower(F.concat_ws(" ", "p_type", "p_brand", "p_name")).alias("text"))
    return X.windowed_ratio(p.select("p_partkey", "p_name").join(after, "p_partkey"), "p_name", "text").select("p_partkey", "ratio", "start", "length")
