"""State machines with keyed state and event-time timers: one-time codes with lockout, idle expiry, ring buffer.

All run by `transformWithStateInPandas`.  Within a micro-batch a key's rows are
taken by time, then number; across batches they are taken as they come, at a
clock that never runs back.  Rows that come later than the watermark allows are
dropped.  State is bounded for each key and goes by timers once the
watermark has passed what it waits for.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: The store that keyed state with several variables and timers needs.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MICROS = 1_000_000


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside use the state store that these machines need; the session's own setting comes back."""
    before = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        spark.conf.set(_STORE[0], before)


@dataclass(frozen=True)
class GateRules:
    """Lifetime of a code, pending codes of a realm, and lockout: so many failures within a window lock for a time."""

    ttl: int = 15 * 60 * MICROS
    capacity: int = 50
    window: int = 5 * 60 * MICROS
    lock: int = 5 * 60 * MICROS
    realm_failures: int = 20
    client_failures: int = 5


class Gate:
    """One realm's codes, failures and locks at a clock; small, as at most `realm_failures` failures lie in a window.

    A claim of a locked client is LOCKED and counts nowhere; one during a lock of
    the realm is LOCKED for every client.  A claim of a pending code is CLAIMED and
    takes it; any other is INVALID, whatever the reason, and a failure of the client
    and of the realm.  A failure that fills a count locks and resets that count.
    CREATED codes are pending for `ttl`; with `capacity` pending the next is FULL,
    and a code that is still pending is TAKEN.
    """

    def __init__(self, rules: GateRules, codes: dict[str, int], failures: list[tuple[str, int]], mine: list[tuple[str, int]], locks: dict[str, int], until: int, clock: int):
        self.rules, self.codes, self.failures, self.mine, self.locks, self.until, self.clock = rules, codes, failures, mine, locks, until, clock

    def pass_time(self, at: int) -> None:
        self.clock = now = max(at, self.clock)
        self.codes = {c: t for c, t in self.codes.items() if t > now}
        self.failures, self.mine = ([(c, t) for c, t in x if now - t < self.rules.window] for x in (self.failures, self.mine))
        self.locks = {c: t for c, t in self.locks.items() if t > now}

    def create(self, code: str) -> str:
        if len(self.codes) >= self.rules.capacity:
            return "FULL"
        if code in self.codes:
            return "TAKEN"
        self.codes[code] = self.clock + self.rules.ttl
        return "CREATED"

    def claim(self, code: str | None, client: str | None) -> str:
        if client in self.locks or self.clock < self.until:
            return "LOCKED"
        if self.codes.pop(code, None) is not None:
            return "CLAIMED"
        self.failures.append((client, self.clock))
        if len(self.failures) >= self.rules.realm_failures:
            self.until, self.failures = self.clock + self.rules.lock, []
        if client is not None:
            self.mine.append((client, self.clock))
            if sum(c == client for c, _ in self.mine) >= self.rules.client_failures:
                self.locks[client] = self.clock + self.rules.lock
                self.mine = [(c, t) for c, t in self.mine if c != client]
        return "INVALID"

    def due(self) -> int | None:
        """When the last of what is held has passed; None if nothing is."""
        held = [*self.codes.values(), *self.locks.values(), *(t + self.rules.window for _, t in self.failures + self.mine), *([self.until] if self.until > self.clock else [])]
        return max(held, default=None)


def _milliseconds(micros: int) -> int:
    return -(-micros // 1000)


class _GateProcessor(StatefulProcessor):
    def __init__(self, rules: GateRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.codes = handle.getMapState("codes", "code string", "until long")
        self.locks = handle.getMapState("locks", "client string", "until long")
        self.failures = handle.getListState("failures", "client string, at long")
        self.mine = handle.getListState("mine", "client string, at long")
        self.realm = handle.getValueState("realm", "until long, clock long")

    def _load(self) -> Gate:
        until, clock = self.realm.get() if self.realm.exists() else (0, -(1 << 62))
        maps = ({k[0]: v[0] for k, v in m.iterator()} if m.exists() else {} for m in (self.codes, self.locks))
        lists = ([tuple(x) for x in m.get()] if m.exists() else [] for m in (self.failures, self.mine))
        codes, locks = maps
        failures, mine = lists
        return Gate(self.rules, codes, failures, mine, locks, until, clock)

    def _save(self, gate: Gate) -> None:
        for state, now in ((self.codes, gate.codes), (self.locks, gate.locks)):
            state.clear()
            for k, v in now.items():
                state.updateValue((k,), (v,))
        for state, now in ((self.failures, gate.failures), (self.mine, gate.mine)):
            state.clear()
            if now:
                state.put(now)
        self.realm.update((gate.until, gate.clock))

    def _timer(self, gate: Gate) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if (due := gate.due()) is not None:
            self.handle.registerTimer(_milliseconds(due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        gate, out = self._load(), []
        some = pd.concat(list(rows)).sort_values(["micros", "seq"], kind="stable")
        for seq, micros, kind, code, client in some[["seq", "micros", "kind", "code", "client"]].itertuples(index=False):
            client = None if pd.isna(client) else client
            gate.pass_time(int(micros))
            verdict = gate.create(code) if kind == "create" else gate.claim(None if pd.isna(code) else code, client)
            out.append((key[0], int(seq), verdict))
        self._save(gate)
        self._timer(gate)
        yield pd.DataFrame(out, columns=["realm", "seq", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gate = self._load()
        gate.pass_time(timerValues.getCurrentWatermarkInMs() * 1000)
        if gate.due() is None:  # silent for so long that nothing is pending, counted or locked
            for state in (self.codes, self.locks, self.failures, self.mine, self.realm):
                state.clear()
        yield pd.DataFrame({"realm": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "verdict": pd.Series(dtype="str")})

    def close(self) -> None:
        pass


def code_gate(requests: DataFrame, rules: GateRules = GateRules(), late: str = "0 seconds") -> DataFrame:
    """(realm, seq, verdict) of a stream of (realm long, seq long, at timestamp, kind, code, client).

    kind is 'create' or 'claim'; `Gate` says what becomes of each.  Realms are
    independent of one another and spread the work.
    """
    rows = requests.withWatermark("at", late).selectExpr("realm", "seq", "at", "unix_micros(at) AS micros", "kind", "code", "client")
    return rows.groupBy("realm").transformWithStateInPandas(_GateProcessor(rules), "realm long, seq long, verdict string", "Append", "EventTime")


def code_gate_batch(requests: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """(realm, seq, verdict) of a complete table of requests.

    Each realm's requests are sorted by time, then number, and stream through one
    task by Arrow batches; what is held is the gate, not the realm.
    """
    rows = requests.selectExpr("realm", "seq", "unix_micros(at) AS micros", "kind", "code", "client").repartition("realm").sortWithinPartitions("realm", "micros", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        realm, gate = None, None
        for some in batches:
            out = []
            for own, micros, kind, code, client in some[["realm", "micros", "kind", "code", "client"]].itertuples(index=False):
                if gate is None or own != realm:
                    realm, gate = own, Gate(rules, {}, [], [], {}, 0, -(1 << 62))
                gate.pass_time(int(micros))
                out.append(gate.create(code) if kind == "create" else gate.claim(code, client))
            yield some[["realm", "seq"]].assign(verdict=out)

    return rows.mapInPandas(run, "realm long, seq long, verdict string")


class _IdleProcessor(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _expired(self, key, micros: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(micros), "expired": micros}).astype({"key": "int64", "expired": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, last = [], self.last.get()[0] if self.last.exists() else None
        before = last
        for micros in sorted(int(x) for some in rows for x in some["micros"]):
            if last is not None and micros > last + self.idle:
                out.append(last + self.idle)
            last = micros if last is None else max(last, micros)
        self.last.update((last,))
        if before is not None:
            self.handle.deleteTimer(_milliseconds(before + self.idle))
        self.handle.registerTimer(_milliseconds(last + self.idle))
        yield self._expired(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.last.exists():
            out = [self.last.get()[0] + self.idle]
            self.last.clear()
        yield self._expired(key, out)

    def close(self) -> None:
        pass


def idle_expiry(rows: DataFrame, key: str, at: str, idle: int, late: str = "0 seconds") -> DataFrame:
    """(key, expired): for each silence of over `idle` microseconds of a key, when it was over.

    A key that stays silent expires when the watermark passes that time; no
    further row of it is needed.
    """
    own = rows.withWatermark(at, late).selectExpr(f"`{key}` AS key", f"`{at}` AS at", f"unix_micros(`{at}`) AS micros")
    return own.groupBy("key").transformWithStateInPandas(_IdleProcessor(idle), "key long, expired long", "Append", "EventTime")


class _RingProcessor(StatefulProcessor):
    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "item string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = [x[0] for x in self.held.get()] if self.held.exists() else [], []
        some = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, item in some[["seq", "item"]].itertuples(index=False):
            held = [*held, item][-self.size :]
            out.append((key[0], int(seq), "".join(held)))
        self.held.put([(x,) for x in held])
        yield pd.DataFrame(out, columns=["key", "seq", "held"])

    def close(self) -> None:
        pass


def ring_buffer(rows: DataFrame, size: int) -> DataFrame:
    """(key, seq, held): each row of a stream of (key long, seq long, item string) with its key's last `size` items, itself included; older ones leave the state."""
    return rows.groupBy("key").transformWithStateInPandas(_RingProcessor(size), "key long, seq long, held string", "Append", "None")
