"""Keyed-state streams: one-time codes with lockout, idle expiry, ring buffer; rules, restarts and batch twins."""

import random
import uuid

import pytest

from evidloom.streaming import processors as P
from evidloom.streaming import stateful

SECOND = P.MICROS
MINUTE = 60 * SECOND


def gate(**rules):
    return P.Gate(P.GateRules(**rules), {}, [], [], {}, 0, -(1 << 62))


def at(g, time, what, code="x", client=None):
    g.pass_time(time)
    return g.create(code) if what == "create" else g.claim(code, client)


def test_a_code_is_claimed_once_within_its_lifetime():
    g = gate()
    assert [at(g, 0, "create"), at(g, 1, "create"), at(g, 15 * MINUTE - 1, "claim"), at(g, 15 * MINUTE - 1, "claim")] == ["CREATED", "TAKEN", "CLAIMED", "INVALID"]
    assert [at(g, 20 * MINUTE, "create"), at(g, 35 * MINUTE, "claim")] == ["CREATED", "INVALID"]  # over just when its time is
    assert at(g, 36 * MINUTE, "create") == "CREATED"  # an expired code's name is free again


def test_capacity_counts_pending_codes_only():
    g = gate(capacity=3)
    assert [at(g, 0, "create", str(i)) for i in range(4)] == ["CREATED"] * 3 + ["FULL"]
    assert [at(g, 1, "claim", "1"), at(g, 2, "create", "3")] == ["CLAIMED", "CREATED"]
    assert at(g, 15 * MINUTE, "create", "4") == "CREATED"


def test_twenty_failures_lock_a_realm_for_five_minutes_and_reset():
    g = gate()
    at(g, 0, "create")
    assert {at(g, i, "claim", "wrong") for i in range(20)} == {"INVALID"}
    assert at(g, 20, "claim") == "LOCKED"
    assert at(g, 19 + 5 * MINUTE - 1, "claim") == "LOCKED"
    assert at(g, 19 + 5 * MINUTE, "claim") == "CLAIMED"
    assert {at(g, 6 * MINUTE + i, "claim", "wrong") for i in range(19)} == {"INVALID"}
    at(g, 6 * MINUTE + 30, "create", "y")
    assert at(g, 6 * MINUTE + 31, "claim", "y") == "CLAIMED"  # the lock began a new count


def test_failures_outside_the_window_do_not_add_up():
    g = gate()
    at(g, 0, "create")
    for start in (0, 5 * MINUTE + 20):
        assert {at(g, start + i, "claim", "wrong", f"c{i}") for i in range(19)} == {"INVALID"}
    assert at(g, 5 * MINUTE + 50, "claim") == "CLAIMED"


def test_five_failures_lock_one_client_only_and_its_tries_count_nowhere():
    g = gate()
    at(g, 0, "create")
    assert [at(g, i, "claim", "wrong", "a") for i in range(5)] == ["INVALID"] * 5
    assert {at(g, 5 + i, "claim", "x", "a") for i in range(500)} == {"LOCKED"}
    assert len(g.failures) == 5 and at(g, 600, "claim", "x", "b") == "CLAIMED"
    assert at(g, 4 + 5 * MINUTE, "claim", "wrong", "a") == "INVALID" and len(g.mine) == 1


def test_four_clients_of_five_failures_lock_the_realm_and_nineteen_do_not():
    g = gate()
    at(g, 0, "create", "x")
    for c in "abc":
        assert {at(g, 1, "claim", "wrong", c) for _ in range(5)} == {"INVALID"}
    assert {at(g, 2, "claim", "wrong", "d") for _ in range(4)} == {"INVALID"}
    assert at(g, 3, "claim", "x", "e") == "CLAIMED"
    at(g, 4, "create", "y")
    assert [at(g, 5, "claim", "wrong", "f"), at(g, 6, "claim", "y", "e"), at(g, 7, "create", "z")] == ["INVALID", "LOCKED", "CREATED"]


def test_what_is_held_stays_small():
    g = gate()
    for i in range(100_000):
        at(g, i * 1000, "claim", "wrong", f"c{i}")
    assert len(g.failures) < 20 and len(g.mine) <= 20 and not g.codes
    g.pass_time(1 << 60)
    assert g.due() is None


SCHEMA = "realm long, seq long, seconds long, kind string, code string, client string"


def plain_loop(rows):
    """The rules again, by a search of all that has happened."""
    out = {}
    for realm in {r[0] for r in rows}:
        created, taken, fails, locks = [], set(), [], []  # (code, time), numbers of created, (client, time, in realm count, in client count), (who, from)
        for _, seq, s, kind, code, client in sorted((r for r in rows if r[0] == realm), key=lambda r: (r[2], r[1])):
            live = [i for i, (c, t) in enumerate(created) if i not in taken and s < t + 900]
            locked = any(who in (client, "") and t <= s < t + 300 for who, t in locks if who is not None)
            if kind == "create":
                verdict = "FULL" if len(live) >= 50 else "TAKEN" if any(created[i][0] == code for i in live) else "CREATED"
                if verdict == "CREATED":
                    created.append((code, s))
            elif locked:
                verdict = "LOCKED"
            elif hit := [i for i in live if created[i][0] == code]:
                verdict = "CLAIMED"
                taken.add(hit[0])
            else:
                verdict = "INVALID"
                fails.append([client, s, True, True])
                ours = [f for f in fails if f[2] and s - f[1] < 300]
                if len(ours) >= 20:
                    locks.append(("", s))
                    for f in fails:
                        f[2] = False
                own = [f for f in fails if f[3] and f[0] == client and s - f[1] < 300]
                if client is not None and len(own) >= 5:
                    locks.append((client, s))
                    for f in fails:
                        f[3] &= f[0] != client
            out[realm, seq] = verdict
    return out


def requests(rng, n):
    rows, seconds = [], 1000  # a watermark begins at 0
    for seq in range(n):
        seconds += rng.choice([0, 0, 1, 3, 6])
        kind = "create" if rng.random() < 0.4 else "claim"
        rows.append((rng.randrange(3), seq, seconds, kind, str(rng.randrange(40)), rng.choice([None, "a", "b", "c", "d"])))
    return rows


def test_a_stream_with_restarts_equals_a_plain_loop_and_the_batch_form(spark):
    rows = requests(random.Random(4), 900)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("realm", "seq", "timestamp_seconds(seconds) AS at", "kind", "code", "client")
    want = plain_loop(rows)
    assert {(r["realm"], r["seq"]): r["verdict"] for r in P.code_gate_batch(df).collect()} == want
    assert set(want.values()) == {"CREATED", "TAKEN", "CLAIMED", "INVALID", "LOCKED"}
    name = f"gate-{uuid.uuid4().hex}"
    folder = f"{stateful.checkpoint_folder(spark)}/{name}"
    with P.keyed_state(spark):
        for k in range(3):
            df.where(f"seq >= {300 * k} and seq < {300 * k + 300}").write.parquet(f"{folder}/{k}")
            got = stateful.run_to_table(P.code_gate(spark.readStream.schema(df.schema).parquet(f"{folder}/*"), late="1 hour"), name).collect()
    assert {(r["realm"], r["seq"]): r["verdict"] for r in got} == want and len(got) == 900


def test_a_key_that_stays_silent_expires_when_the_watermark_passes(spark):
    name = f"idle-{uuid.uuid4().hex}"
    folder = f"{stateful.checkpoint_folder(spark)}/{name}"

    def after(k, rows):
        spark.createDataFrame(rows, "k long, s long").selectExpr("k", "timestamp_seconds(s) AS at").write.parquet(f"{folder}/{k}")
        with P.keyed_state(spark):
            source = spark.readStream.schema("k long, at timestamp").parquet(f"{folder}/*")
            out = stateful.run_to_table(P.idle_expiry(source, "k", "at", 60 * SECOND), name)
        return sorted((r["key"], r["expired"] // SECOND) for r in out.collect())

    assert after(0, [(1, 0), (1, 50), (2, 70), (3, 100)]) == []
    assert after(1, [(3, 120)]) == [(1, 110)]  # no row of key 1 came
    assert after(2, [(3, 500), (2, 125)]) == [(1, 110), (2, 185), (3, 180)]


def test_a_ring_buffer_holds_no_more_than_its_size(spark):
    name = f"ring-{uuid.uuid4().hex}"
    folder = f"{stateful.checkpoint_folder(spark)}/{name}"
    with P.keyed_state(spark):
        for k in range(2):
            spark.createDataFrame([(key, i, str(i)) for key in (1, 2) for i in range(4 * k, 4 * k + 4)], "key long, seq long, item string").write.parquet(f"{folder}/{k}")
            out = stateful.run_to_table(P.ring_buffer(spark.readStream.schema("key long, seq long, item string").parquet(f"{folder}/*"), 3), name)
    assert sorted((r["key"], r["seq"], r["held"]) for r in out.collect()) == sorted((key, i, "".join(map(str, range(max(0, i - 2), i + 1)))) for key in (1, 2) for i in range(8))


def test_the_session_keeps_its_own_state_store(spark):
    before = spark.conf.get(P._STORE[0])
    with pytest.raises(RuntimeError), P.keyed_state(spark):
        raise RuntimeError
    assert spark.conf.get(P._STORE[0]) == before
