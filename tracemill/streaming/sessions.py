"""The ledger and the status of every session, kept while deliveries arrive.

The state of a session is its turn, the model that holds, whether a turn has just opened, its status and the ids it has
seen; a micro-batch's deliveries of a session are applied in their order. Every read and write of state is a message from
Python to the JVM, so sessions are dealt by hash to ``PAGES`` pages: a micro-batch reads and writes a page that it touches
once, and of the ids its sessions have seen those slots that it needs. What changes goes out as rows that replace earlier
ones with the same key. Silence is told by timers on the clock of the cluster: a session that works and says
nothing for too long is over, and the next delivery wakes it. There is no watermark, as a delivery that mends an old one
carries the old one's time and must not be dropped for it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import BOUNDARIES, CLOSERS, TOKENS
from ..operators.timeline import SETTLE_MS, STALE_MS, WORK

#: Pages that sessions are dealt to, and ids that a slot of a page holds on average at most. A checkpoint belongs to its number of pages.
PAGES, SLOT = 4096, 512
STATE = "sessions string, slots bigint, ids bigint, timer bigint"
OUT = "session string, what string, id string, seq bigint, step_idx bigint, turn bigint, ts_ms bigint, model string, " + ", ".join(f"{c} bigint" for c in TOKENS) + ", status string, since bigint, reason string, last bigint, version bigint"
NAMES = [c.split()[0] for c in OUT.split(", ")]
MADE = Row(*NAMES)
PLACE = {c: n for n, c in enumerate(NAMES)}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _row(session: str, what: str, id_: str, **fields) -> Row:
    values = [None] * len(NAMES)
    values[:3] = session, what, id_
    for c, v in fields.items():
        values[PLACE[c]] = v
    return MADE(*values)


class Sessions(StatefulProcessor):
    """The sessions of one page at a time; see the module."""

    def __init__(self, stale_ms: int = STALE_MS, settle_ms: int = SETTLE_MS):
        self.stale_ms, self.settle_ms = stale_ms, settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("page", STATE)
        # A boundary's id has nothing beside it; a step's has its number, its first turn and position, and the model it has so far.
        self.seen = handle.getMapState("seen", "slot bigint", "ids string")

    def _load(self) -> tuple[dict, int, int, int | None]:
        """(sessions, slots of ids, ids, the timer that is set) of a page."""
        held = self.state.get()
        return ({}, 1, 0, None) if held is None else (json.loads(held[0]), held[1], held[2], held[3])

    def _save(self, sessions: dict, slots: int, ids: int, timer: int | None) -> None:
        """A page has one timer, that of the session which is due first."""
        due = min((s[8] for s in sessions.values() if s[8] is not None), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((json.dumps(sessions), slots, ids, due))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sessions, slots, ids, timer = self._load()
        now, held = timerValues.getCurrentProcessingTimeInMs(), {}
        fresh = ids == 0

        def slot(session: str, id_: str) -> dict:
            """The ids that are kept together with this one; read once a micro-batch."""
            n = zlib.crc32(f"{session} {id_}".encode()) % slots
            if n not in held:
                found = None if fresh else self.seen.getValue((n,))
                held[n] = {} if found is None else json.loads(found[0])
            return held[n].setdefault(session, {})

        added = 0
        for session, own in groupby(sorted(rows, key=lambda r: (r["session"], r["seq"])), key=lambda r: r["session"]):
            s = sessions.setdefault(session, [0, False, None, 0, None, 0, "", 0, None, 0])
            changed: dict[tuple, Row] = {}
            before = s[4:8]
            for r in own:
                self._status(s, r)
                known = slot(session, r["id"]) if r["kind"] == "usage" or r["kind"] in BOUNDARIES and not r["synthetic"] else None
                n = 0 if known is None else len(known)
                out = self._ledger(s, r, known)
                added += 0 if known is None else len(known) - n
                if out is not None:
                    changed[out[1], out[2]] = out
            yield from changed.values()
            if s[4:8] != before:
                s[9] += 1
                yield _row(session, "status", "", status=s[4], since=s[5], reason=s[6], last=s[7], version=s[9])
                s[8] = self._due(s)
                if s[8] is not None and s[8] < now:
                    yield self._over(session, s)
        ids += added
        if ids > SLOT * slots:
            # Twice the slots or more: what is kept is dealt anew, which each id goes through a few times at most.
            for n in range(0 if fresh else slots):
                if n not in held and (found := self.seen.getValue((n,))) is not None:
                    held[n] = json.loads(found[0])
            while ids > SLOT * slots:
                slots *= 2
            dealt: dict[int, dict] = {}
            for part in held.values():
                for session, known in part.items():
                    for id_, v in known.items():
                        dealt.setdefault(zlib.crc32(f"{session} {id_}".encode()) % slots, {}).setdefault(session, {})[id_] = v
            held = dealt
        for n, part in held.items():
            self.seen.updateValue((n,), (json.dumps(part),))
        self._save(sessions, slots, ids, timer)

    def _ledger(self, s: list, r: Row, known: dict | None) -> Row | None:
        kind, id_ = r["kind"], r["id"]
        if kind in BOUNDARIES and not r["synthetic"]:
            if id_ in known:
                return None
            known[id_] = None
            if not s[1]:
                s[0], s[1] = s[0] + 1, True
            return _row(r["session"], "prompt", id_, seq=r["seq"], turn=s[0], ts_ms=r["ts_ms"]) if kind == "user_message" else None
        if kind in ("assistant_message", "meta") and r["model"]:
            s[2] = r["model"]
        if kind in CLOSERS and kind != "user_message":
            s[1] = False
        if kind != "usage":
            return None
        old = known.get(id_)
        if old is None:
            s[3] += 1
            old = [s[3], s[0], r["seq"], s[2], False]
        model, own = (r["model"], True) if r["model"] is not None else (old[3], old[4])
        known[id_] = [old[0], old[1], old[2], model, own]
        return _row(r["session"], "step", id_, seq=old[2], step_idx=old[0], turn=old[1], ts_ms=r["ts_ms"], model=model, **{c: r[c] for c in TOKENS})

    def _status(self, s: list, r: Row) -> None:
        if r["partial"]:
            now, reason = "work", "streaming"
        elif r["kind"] in WORK or r["kind"] == "turn_end":
            now, reason = "idle" if r["kind"] == "turn_end" else "work", r["kind"]
        else:
            return
        s[7] = max(s[7] or 0, r["ts_ms"])
        if s[4] != now:
            s[4], s[5] = now, s[7]
        s[6] = reason

    def _due(self, s: list) -> int | None:
        """When a session that works and says nothing more is over."""
        window = min(self.settle_ms, self.stale_ms) if s[6] == "assistant_message" else self.stale_ms
        return s[7] + window + 1 if s[4] == "work" and window > 0 else None

    def _over(self, session: str, s: list) -> Row:
        # What is kept stays 'work': the next delivery decides anew, and since when follows from its own change.
        s[9] += 1
        due, s[8] = s[8], None
        return _row(session, "status", "", status="idle", since=due - 1, reason="stale", last=s[7], version=s[9])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sessions, slots, ids, timer = self._load()
        due = expiredTimerInfo.getExpiryTimeInMs()
        for session, s in sessions.items():
            if s[8] is not None and s[8] <= max(due, timerValues.getCurrentProcessingTimeInMs() - 1):
                yield self._over(session, s)
        # A timer that has gone off is gone.
        self._save(sessions, slots, ids, None if timer == due else timer)

    def close(self) -> None:
        pass


def kept_up(deliveries: DataFrame, stale_ms: int = STALE_MS, settle_ms: int = SETTLE_MS) -> DataFrame:
    """A stream of changes (OUT) of steps, prompts and statuses from a stream of deliveries: session, id, seq, ts_ms, kind, model and TOKENS, and maybe synthetic and partial.

    Deliveries of a session come in the order of ``seq`` from micro-batch to micro-batch; within one they are put in it.
    """
    spark = deliveries.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c) if c in deliveries.columns else F.lit(False).alias(c)
    rows = deliveries.select("session", "id", "seq", "ts_ms", "kind", "model", *TOKENS, flag("synthetic"), flag("partial"))
    return rows.withColumn("page", F.pmod(F.xxhash64("session"), F.lit(PAGES))).groupBy("page").transformWithState(Sessions(stale_ms, settle_ms), OUT, "Update", "ProcessingTime")


def keep(changes: DataFrame, folder: str, checkpoint: str, every: str | None = None):
    """Starts a query that writes the changes of every micro-batch once.

    It runs on ``every`` so often, or takes one micro-batch of all there is and ends (a query with timers on the clock
    would not end by itself otherwise).
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    trigger = {"once": True} if every is None else {"processingTime": every}
    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """All changes (OUT and batch) that ``keep`` wrote."""
    return spark.read.schema(OUT + ", batch bigint").parquet(folder)


def current(changes: DataFrame, what: str, until: int | None = None) -> DataFrame:
    """The latest row of each step, prompt or session among ``changes``, up to micro-batch ``until``."""
    rows = changes.where(F.col("what") == what)
    rows = rows if until is None else rows.where(F.col("batch") <= until)
    fields = [c for c in NAMES if c not in ("session", "id", "what")]
    return rows.groupBy("session", "id").agg(F.max_by(F.struct(*fields), F.struct("batch", "version")).alias("r")).select("session", "id", "r.*")
