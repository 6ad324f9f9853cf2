"""Queries ST1 to ST18: streaming rules, as batch twins with SQL and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import streams as ST
from ..operators.windows import micros
from ..registry import query
from ..streaming import processors, stateful
from .fixtures import OBSERVATIONS, observations, table

#: Frames: a user's events in order, loud where the value is at least 8.
FRAMES = "frames AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS frame_no, value >= 8 AS speech, value, ts FROM events)"
RUNS = f"""{FRAMES}, nr AS (SELECT *, CASE WHEN speech IS DISTINCT FROM lag(speech) OVER (PARTITION BY stream_id ORDER BY frame_no) THEN 1 ELSE 0 END AS c FROM frames),
  rr AS (SELECT *, sum(c) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS run FROM nr),
  runs AS (SELECT stream_id, run, any_value(speech) AS speech, min(frame_no) AS first, max(frame_no) AS last, count(*) AS n FROM rr GROUP BY stream_id, run)"""
UTTERANCES = f"""{RUNS}, q AS (SELECT stream_id, speech, first + CASE WHEN speech THEN 1 ELSE 2 END AS here FROM runs WHERE (speech AND n >= 2) OR (NOT speech AND n >= 3)),
  l AS (SELECT *, coalesce(lag(speech) OVER (PARTITION BY stream_id ORDER BY here), false) AS was FROM q),
  g AS (SELECT *, CAST(sum(CASE WHEN speech AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY here ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM l WHERE speech OR was),
  utt AS (SELECT stream_id, episode, min(here) AS started, max(here) FILTER (NOT speech) AS ended FROM g GROUP BY ALL)"""


def frames(spark, d):
    e = table(spark, d, "events", "user_id", "ts", "value")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("long")
    return e.select(F.col("user_id").alias("stream_id"), number.alias("frame_no"), (F.col("value") >= 8).alias("speech"), "value", "ts")


def utterances(spark, d):
    return ST.utterances(frames(spark, d), "stream_id", "frame_no", F.col("speech"), 2, 3)


@query("ST1_utterances", f"WITH {UTTERANCES} SELECT stream_id, episode, started, ended FROM utt")
def st1(spark, d):
    return utterances(spark, d)


@query("ST1_endpoints_stream", f"WITH {UTTERANCES} SELECT stream_id, 'start' AS kind, started AS frame_no FROM utt UNION ALL SELECT stream_id, 'end', ended FROM utt WHERE ended IS NOT NULL")
def st1_stream(spark, d):
    folder = f"{stateful.checkpoint_folder(spark)}/frames-{uuid.uuid4().hex}"
    frames(spark, d).select("stream_id", "frame_no", "speech").write.parquet(folder)
    source = spark.readStream.schema("stream_id long, frame_no long, speech boolean").parquet(folder)
    return stateful.run_to_table(stateful.endpoints(source, 2, 3), f"endpoints-{uuid.uuid4().hex}")


@query("ST2_pre_roll", f"""WITH {UTTERANCES} SELECT u.stream_id, u.episode, count(*) AS n, round(sum(f.value), 6) AS energy FROM utt u JOIN frames f ON f.stream_id = u.stream_id AND f.frame_no BETWEEN u.started - 3 AND u.started GROUP BY ALL""")
def st2(spark, d):
    w = Window.partitionBy("stream_id").orderBy("frame_no").rowsBetween(-3, 0)
    f = frames(spark, d).select("stream_id", F.col("frame_no").alias("started"), F.count("*").over(w).alias("n"), F.round(F.sum("value").over(w), 6).alias("energy"))
    return utterances(spark, d).join(f, ["stream_id", "started"]).select("stream_id", "episode", "n", "energy")


@query("ST3_ring_buffer", f"WITH {FRAMES} SELECT stream_id, frame_no, array_to_string(list(CAST(speech AS INT)) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), '') AS held FROM frames")
def st3(spark, d):
    w = Window.partitionBy("stream_id").orderBy("frame_no").rowsBetween(-4, 0)
    return frames(spark, d).select("stream_id", "frame_no", F.array_join(F.collect_list(F.col("speech").cast("int").cast("string")).over(w), "").alias("held"))


@query("ST4_maximum_duration", f"""WITH {UTTERANCES}, m AS (SELECT stream_id, max(frame_no) AS m FROM frames GROUP BY 1), s AS (SELECT u.stream_id, episode, started, coalesce(ended, m) AS ended FROM utt u JOIN m USING (stream_id))
  SELECT stream_id, episode, CAST(k AS BIGINT) AS part, started + 4 * k AS "from", least(started + 4 * k + 3, ended) AS "to" FROM s, range(0, 200) r(k) WHERE started + 4 * k <= ended""")
def st4(spark, d):
    end = frames(spark, d).groupBy("stream_id").agg(F.max("frame_no").alias("m"))
    s = utterances(spark, d).join(end, "stream_id").withColumn("ended", F.coalesce("ended", "m"))
    parts = s.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(ended - started) div 4"))))
    return parts.select("stream_id", "episode", "part", (F.col("started") + 4 * F.col("part")).alias("from"), F.least(F.col("started") + 4 * F.col("part") + 3, F.col("ended")).alias("to"))


HYPOTHESES = "hyp AS (SELECT l_orderkey AS utt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, [CASE WHEN l_partkey % 3 = 0 THEN 'a' ELSE 'b' END, CASE WHEN l_suppkey % 2 = 0 THEN 'c' ELSE 'd' END, l_returnflag] AS words FROM lineitem)"


def hypotheses(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long")
    words = F.array(F.when(F.col("l_partkey") % 3 == 0, "a").otherwise("b"), F.when(F.col("l_suppkey") % 2 == 0, "c").otherwise("d"), F.col("l_returnflag"))
    return li.select(F.col("l_orderkey").alias("utt"), seq.alias("seq"), words.alias("words"))


@query("ST5_stable_prefix", f"""WITH {HYPOTHESES}, p AS (SELECT utt, seq, words, lag(words) OVER (PARTITION BY utt ORDER BY seq) AS b FROM hyp),
  a AS (SELECT utt, seq, CASE WHEN b IS NULL OR words[1] <> b[1] THEN 0 WHEN words[2] <> b[2] THEN 1 WHEN words[3] <> b[3] THEN 2 ELSE 3 END AS n FROM p)
  SELECT utt, seq, max(n) OVER (PARTITION BY utt ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stable FROM a""")
def st5(spark, d):
    return ST.stable_prefix(hypotheses(spark, d), "utt", "seq", "words").select("utt", "seq", "stable")


@query("ST6_newest_partial", "SELECT user_id, date_trunc('day', ts) AS trigger, max_by(event_id, ts) AS event_id, count(*) - 1 AS n_dropped FROM events GROUP BY ALL")
def st6(spark, d):
    return ST.newest_per_trigger(table(spark, d, "events", "user_id", "ts", "event_id"), "user_id", "ts", "day", "event_id")


@query("ST7_overload_shedding", "SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 15 AS shed FROM events")
def st7(spark, d):
    # The rule only: a stream has no queue to look at, so its input rate is bounded by options of the reader.
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-4, 0)
    return table(spark, d, "events", "event_id", "user_id", "ts", "value").select("event_id", (F.avg("value").over(w) > 15).alias("shed"))


@query("ST8_adaptive_floor", "SELECT event_id, greatest(8.0, round(1.2 * lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts), 6)) AS tick FROM events")
def st8(spark, d):
    # The rule only: a trigger's interval is fixed while its query runs.
    before = F.lag("value", 1, 0.0).over(Window.partitionBy("user_id").orderBy("ts"))
    return table(spark, d, "events", "event_id", "user_id", "ts", "value").select("event_id", F.greatest(F.lit(8.0), F.round(1.2 * before, 6)).alias("tick"))


@query("ST9_speculative_result", f"WITH {RUNS} SELECT stream_id, last AS made_at, n >= 3 AS stands FROM runs WHERE NOT speech AND n >= 2")
def st9(spark, d):
    """A result made after two silent frames stands if a third follows; otherwise the input has resumed and it is dropped."""
    r = ST.runs(frames(spark, d), "stream_id", "frame_no", F.col("speech")).where("not flag and n >= 2")
    return r.select("stream_id", F.col("last").alias("made_at"), (F.col("n") >= 3).alias("stands"))


@query("ST10_idle_expiry", """WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events) SELECT user_id, ts + INTERVAL 36 HOURS AS expired_at FROM g WHERE next > ts + INTERVAL 36 HOURS""")
def st10(spark, d):
    e = table(spark, d, "events", "user_id", "ts").withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")))
    return e.withColumn("expired_at", F.expr("ts + interval 36 hours")).where("next > expired_at").select("user_id", "expired_at")


@query("ST11_one_time_codes", """WITH c AS (SELECT user_id AS code, min(ts) AS created FROM events WHERE event_type = 'signup' GROUP BY 1), a AS (SELECT event_id, user_id AS code, ts AS at_ FROM events WHERE event_type IN ('click', 'purchase')),
  j AS (SELECT a.*, created, coalesce(at_ BETWEEN created AND created + INTERVAL 48 HOURS, false) AS live FROM a LEFT JOIN c USING (code))
  SELECT event_id, code, CASE WHEN created IS NULL THEN 'UNKNOWN' WHEN NOT live THEN 'EXPIRED' WHEN at_ = min(at_) FILTER (live) OVER (PARTITION BY code) THEN 'CLAIMED' ELSE 'USED' END AS verdict FROM j""")
def st11(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").withColumnRenamed("user_id", "code")
    codes = e.where("event_type = 'signup'").groupBy("code").agg(F.min("ts").alias("created"))
    attempts = e.where(F.col("event_type").isin("click", "purchase")).select("event_id", "code", F.col("ts").alias("at"))
    return ST.claims(codes, attempts, "code", "created", "at", 48).select("event_id", "code", "verdict")


@query("ST12_sliding_failures", """SELECT event_id, n, n >= 3 AS locked FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error')""")
def st12(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type = 'error'")
    return ST.sliding_count(e, "user_id", "ts", 172_800, "n").select("event_id", "n", (F.col("n") >= 3).alias("locked"))


@query("ST12_windowed_failures_stream", """SELECT CAST(w AS TIMESTAMP) AS start, user_id, count(*) AS n FROM (SELECT user_id, unnest([date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 6 AS INT))]) AS w FROM events WHERE event_type = 'error') GROUP BY ALL""")
def st12_stream(spark, d):
    e = stateful.event_stream(spark, d).where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("at"), "user_id")
    merged = stateful.upsert_batches(e, f"failures-{uuid.uuid4().hex}", _add_windows)
    return merged.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def _add_windows(batch, before):
    now = batch.groupBy(F.window("at", "6 hours")["start"].alias("start"), "user_id").agg(F.count("*").alias("n"))
    return now if before is None else now.unionByName(before).groupBy("start", "user_id").agg(F.sum("n").alias("n"))


@query("ST13_correction_stream", f"""WITH {OBSERVATIONS}, c AS (SELECT obs_id, patient, node, recorded_at, obs_id - 5 * (1 + obs_id % 3) AS supersedes FROM obs WHERE obs_id % 4 = 0)
  SELECT c.obs_id, CASE WHEN o.obs_id IS NULL THEN 'NO_TARGET' WHEN o.node <> c.node OR o.patient <> c.patient THEN 'OTHER_NODE' WHEN c.recorded_at <= o.recorded_at THEN 'NOT_LATER' ELSE 'VALID' END AS verdict FROM c LEFT JOIN obs o ON c.supersedes = o.obs_id""")
def st13(spark, d):
    o = observations(spark, d)
    c = o.where("obs_id % 4 = 0").withColumn("supersedes", F.expr("obs_id - 5 * (1 + obs_id % 3)"))
    old = o.select(F.col("obs_id").alias("supersedes"), F.col("patient").alias("p"), F.col("node").alias("n"), F.col("recorded_at").alias("r"))
    verdict = F.when(F.col("p").isNull(), "NO_TARGET").when((F.col("n") != F.col("node")) | (F.col("p") != F.col("patient")), "OTHER_NODE").when(F.col("recorded_at") <= F.col("r"), "NOT_LATER").otherwise("VALID")
    return c.join(old, "supersedes", "left").select("obs_id", verdict.alias("verdict"))


@query("ST14_incremental_recompute", f"""WITH {OBSERVATIONS}, n AS (SELECT DISTINCT patient FROM obs WHERE recorded_at > TIMESTAMP '2024-01-28' AND obs_id % 11 = 0) SELECT patient, count(*) FILTER (status = 'POSITIVE') AS n_positive FROM obs JOIN n USING (patient) GROUP BY 1""")
def st14(spark, d):
    o = observations(spark, d)
    touched = o.where("recorded_at > timestamp_ntz'2024-01-28' and obs_id % 11 = 0").select("patient").distinct()
    return o.join(touched, "patient", "left_semi").groupBy("patient").agg(F.count_if(F.col("status") == "POSITIVE").alias("n_positive"))


@query("ST15_late_knowledge", f"WITH {OBSERVATIONS} SELECT obs_id, recorded_at > TIMESTAMP '2024-01-15' AS late FROM obs WHERE observed_at <= TIMESTAMP '2024-01-15'")
def st15(spark, d):
    return observations(spark, d).where("observed_at <= timestamp_ntz'2024-01-15'").select("obs_id", F.expr("recorded_at > timestamp_ntz'2024-01-15'").alias("late"))


@query("ST16_pause_census", f"WITH {RUNS} SELECT stream_id, first, n, last = max(last) OVER (PARTITION BY stream_id) AS censored FROM runs QUALIFY NOT speech")
def st16(spark, d):
    return ST.pause_census(frames(spark, d), "stream_id", "frame_no", F.col("speech"))


@query("ST17_turn_completion", r"SELECT conv_id, turn, CASE WHEN regexp_matches(trim(text), '[?]$') THEN 'QUESTION' WHEN regexp_matches(trim(text), '[.!]$') THEN 'COMPLETE' WHEN regexp_matches(trim(text), '[,;:]$') THEN 'CONTINUES' ELSE 'UNKNOWN' END AS state FROM conversations")
def st17(spark, d):
    t = F.trim("text")
    state = F.when(t.rlike("[?]$"), "QUESTION").when(t.rlike("[.!]$"), "COMPLETE").when(t.rlike("[,;:]$"), "CONTINUES").otherwise("UNKNOWN")
    return table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", state.alias("state"))


@query("ST18_low_speech_filter", f"WITH {FRAMES}, r AS (SELECT stream_id, avg(CAST(speech AS INT)) AS r FROM frames GROUP BY 1) SELECT stream_id, CASE WHEN r < 0.5 THEN '' ELSE 'user ' || stream_id END AS text FROM r")
def st18(spark, d):
    r = frames(spark, d).groupBy("stream_id").agg(F.avg(F.col("speech").cast("int")).alias("r"))
    return r.select("stream_id", F.when(F.col("r") < 0.5, F.lit("")).otherwise(F.concat(F.lit("user "), "stream_id")).alias("text"))


def replayed(spark, parts, stream, name):
    """What a stream gives that is fed part by part, each in a run of its own that goes on from the state of the run before."""
    where, name = f"{stateful.checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}", f"{name}-{uuid.uuid4().hex}"
    with processors.keyed_state(spark):
        for k, part in enumerate(parts):
            part.write.parquet(f"{where}/{k}")
            out = stateful.run_to_table(stream(spark.readStream.schema(part.schema).parquet(f"{where}/*")), name)
    return out


#: Realms of users; the table's month is played in 108 minutes, so that windows of 5 minutes hold many requests.
REQUESTS = """req AS (SELECT user_id % 8 AS realm, event_id AS seq, epoch_us(ts) // 400 AS at_, CASE WHEN event_type = 'signup' THEN 'create' ELSE 'claim' END AS kind,
  CASE event_type WHEN 'error' THEN 'wrong' WHEN 'signup' THEN CAST(event_id % 90 AS VARCHAR) ELSE CAST(event_id * 7 % 90 AS VARCHAR) END AS code, CASE WHEN event_id % 50 <> 0 THEN CAST(user_id AS VARCHAR) END AS client FROM events WHERE event_type <> 'view')"""
#: One request of each realm a step; lists hold what is pending, counted and locked.
GATE = f"""WITH RECURSIVE {REQUESTS}, o AS (SELECT *, row_number() OVER (PARTITION BY realm ORDER BY at_, seq) AS n FROM req),
  st AS (SELECT DISTINCT realm, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS verdict, CAST([] AS STRUCT(k VARCHAR, t BIGINT)[]) AS codes, CAST([] AS BIGINT[]) AS fails, CAST([] AS STRUCT(k VARCHAR, t BIGINT)[]) AS mine, CAST([] AS STRUCT(k VARCHAR, t BIGINT)[]) AS locks, CAST(0 AS BIGINT) AS until FROM o
  UNION ALL SELECT realm, n, seq, verdict,
      CASE verdict WHEN 'CREATED' THEN list_append(codes, {{'k': code, 't': at_ + 900000000}}) WHEN 'CLAIMED' THEN list_filter(codes, lambda c: c.k <> code) ELSE codes END,
      CASE WHEN verdict <> 'INVALID' THEN fails WHEN len(fails) >= 19 THEN [] ELSE list_append(fails, at_) END,
      CASE WHEN verdict <> 'INVALID' OR client IS NULL THEN mine WHEN own >= 4 THEN list_filter(mine, lambda c: c.k <> client) ELSE list_append(mine, {{'k': client, 't': at_}}) END,
      CASE WHEN verdict = 'INVALID' AND client IS NOT NULL AND own >= 4 THEN list_append(locks, {{'k': client, 't': at_ + 300000000}}) ELSE locks END,
      CASE WHEN verdict = 'INVALID' AND len(fails) >= 19 THEN at_ + 300000000 ELSE until END
    FROM (SELECT *, len(list_filter(mine, lambda c: c.k = client)) AS own, CASE WHEN kind = 'create' THEN CASE WHEN len(codes) >= 50 THEN 'FULL' WHEN len(list_filter(codes, lambda c: c.k = code)) > 0 THEN 'TAKEN' ELSE 'CREATED' END
        WHEN len(list_filter(locks, lambda c: c.k = client)) > 0 OR at_ < until THEN 'LOCKED' WHEN len(list_filter(codes, lambda c: c.k = code)) > 0 THEN 'CLAIMED' ELSE 'INVALID' END AS verdict
      FROM (SELECT o.*, list_filter(st.codes, lambda c: c.t > o.at_) AS codes, list_filter(st.fails, lambda t: o.at_ - t < 300000000) AS fails, list_filter(st.mine, lambda c: o.at_ - c.t < 300000000) AS mine, list_filter(st.locks, lambda c: c.t > o.at_) AS locks, st.until FROM st JOIN o ON o.realm = st.realm AND o.n = st.n + 1)))
  SELECT realm, seq, verdict FROM st WHERE n > 0"""


def requests(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type <> 'view'").withColumn("micros", micros("ts")).withColumn("micros", F.expr("micros div 400"))
    code = F.when(F.col("event_type") == "error", "wrong").when(F.col("event_type") == "signup", (F.col("event_id") % 90).cast("string")).otherwise((F.col("event_id") * 7 % 90).cast("string"))
    return e.select((F.col("user_id") % 8).alias("realm"), F.col("event_id").alias("seq"), F.timestamp_micros("micros").alias("at"), F.when(F.col("event_type") == "signup", "create").otherwise("claim").alias("kind"), code.alias("code"), F.when(F.col("event_id") % 50 != 0, F.col("user_id").cast("string")).alias("client"))


@query("ST12_lockout_stream", GATE)
def st12_lockout_stream(spark, d):
    """Codes and lockouts of every realm as a stream in three parts, with a restart between them."""
    r = requests(spark, d)
    first, last = r.agg(F.min("at"), F.max("at")).first()
    cut = [first + (last - first) * share for share in (0.3, 0.7)] if first else [None, None]
    parts = [r.where(F.col("at") < cut[0]), r.where((F.col("at") >= cut[0]) & (F.col("at") < cut[1])), r.where(F.col("at") >= cut[1])]
    return replayed(spark, parts, processors.code_gate, "gate").select("realm", "seq", "verdict")


@query("ST12_lockout_batch", GATE)
def st12_lockout_batch(spark, d):
    """The same rules over a complete table."""
    return processors.code_gate_batch(requests(spark, d))


@query("ST10_idle_expiry_stream", """WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next, max(ts) OVER () AS m FROM events) SELECT user_id, ts + INTERVAL 36 HOURS AS expired_at FROM g WHERE coalesce(next, m) > ts + INTERVAL 36 HOURS""")
def st10_stream(spark, d):
    """Besides gaps between rows, the users that stay silent to the end: they expire as the watermark, the latest time of any user, passes."""
    e = table(spark, d, "events", "user_id", "ts").select("user_id", F.timestamp_micros(micros("ts")).alias("at"))
    out = replayed(spark, [e], lambda s: processors.idle_expiry(s, "user_id", "at", 36 * 3600 * processors.MICROS), "idle")
    return out.select(F.col("key").alias("user_id"), F.timestamp_micros("expired").cast("timestamp_ntz").alias("expired_at"))


@query("ST3_ring_buffer_stream", f"WITH {FRAMES} SELECT stream_id, frame_no, array_to_string(list(CAST(speech AS INT)) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), '') AS held FROM frames")
def st3_stream(spark, d):
    f = frames(spark, d).select(F.col("stream_id").alias("key"), F.col("frame_no").alias("seq"), F.col("speech").cast("int").cast("string").alias("item"))
    out = replayed(spark, [f.where("seq <= 20"), f.where("seq > 20")], lambda s: processors.ring_buffer(s, 5), "ring")
    return out.select(F.col("key").alias("stream_id"), F.col("seq").alias("frame_no"), "held")
