"""Bounded state of an owner's confirmations, jobs and conversations in a stream, with timers that free what has run out.

Records of one owner lie in a map state. Events of a batch are taken in the order of (time, event_id); a clock that never runs backwards decides
what has run out before each event, so results don't wait for the watermark. A timer at the earliest end of any record frees state
of owners who don't come back. What is held is bounded: records by their limit, a record by its own limits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SECOND = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "owner string, us long, event_id long, id string, outcome string"
EVENT = ["owner", "us", "event_id", "kind", "id", "request", "size"]

# Times in seconds, numbers and bytes that the stores keep to.
CONFIRMATION_IDLE, CONFIRMATION_AGE, CONFIRMATIONS = 30 * 60, 2 * 60 * 60, 64
JOB_KEPT, JOBS_AT_ONCE, REPLAY_EVENTS, REPLAY_BYTES = 60, 2, 32, 1_000_000
CONVERSATION_IDLE, CONVERSATIONS, CONVERSATION_BYTES, ALL_BYTES, TURN_RESERVE, BASE_BYTES = 1800, 16, 8 << 20, 64 << 20, 2 << 20, 1024
LATEST_ONLY = ("deep_progress", "status", "budget")


class Keeper(StatefulProcessor):
    """Rules of one store: step() answers an event, ends() says when a record runs out (it is gone after that time, or at it if `closed`)."""

    closed = False

    def step(self, held: dict[str, dict], kind: str, id_: str, request: str, size: int, now: int, gone) -> str | None:
        raise NotImplementedError

    def ends(self, record: dict) -> int | None:
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "id string", "record string")
        self.clock = handle.getValueState("clock", "us long")

    def close(self) -> None:
        pass

    def _purge(self, held: dict[str, dict], now: int, gone) -> None:
        for id_ in sorted(held):
            end = self.ends(held[id_])
            if end is not None and (now > end or self.closed and now == end):
                del held[id_]
                gone(id_, "expired")

    def _keep(self, before: dict[str, dict], held: dict[str, dict]) -> None:
        """Writes what changed, and sets one timer: at the earliest end."""
        for id_ in before.keys() - held.keys():
            self.records.removeKey((id_,))
        for id_, record in held.items():
            if before.get(id_) != record:
                self.records.updateValue((id_,), (json.dumps(record),))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        ends = [e for e in map(self.ends, held.values()) if e is not None]
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + 1)
        if not held and self.clock.exists():
            self.clock.clear()

    def _held(self) -> dict[str, dict]:
        return {key[0]: json.loads(value[0]) for key, value in self.records.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        before = {k: dict(v) for k, v in held.items()}
        clock = self.clock.get()[0] if self.clock.exists() else 0
        out: list[tuple] = []
        events = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
        for us, event_id, kind, id_, request, size in zip(*(events[c].tolist() for c in EVENT[1:])):
            clock = max(clock, us)
            gone = lambda other, why: out.append((key[0], clock, -1, other, why))  # noqa: B023, E731
            self._purge(held, clock, gone)
            answer = self.step(held, kind, id_, request, size, clock, gone)
            if answer:
                out.append((key[0], us, event_id, id_, answer))
        self.clock.update((int(clock),))
        self._keep(before, held)
        yield pd.DataFrame(out, columns=["owner", "us", "event_id", "id", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        before, now, out = dict(held), timerValues.getCurrentWatermarkInMs() * 1000, []
        self._purge(held, now, lambda other, why: out.append((key[0], now, -1, other, why)))
        self._keep(before, held)
        yield pd.DataFrame(out, columns=["owner", "us", "event_id", "id", "outcome"])


class Confirmations(Keeper):
    """Questions that wait for a choice: they end 30 minutes after the last step that was completed and two hours after they were
    asked; of 64 the one untouched for longest gives way. Looking at one doesn't prolong it; one step at a time is worked on."""

    def __init__(self, limit: int = CONFIRMATIONS, idle: int = CONFIRMATION_IDLE, age: int = CONFIRMATION_AGE):
        self.limit, self.idle, self.age = limit, idle * SECOND, age * SECOND

    def ends(self, record: dict) -> int:
        return min(record["completed"] + self.idle, record["created"] + self.age)

    def step(self, held, kind, id_, request, size, now, gone):
        if kind == "create":
            held.pop(id_, None)
            while len(held) >= self.limit:
                oldest = min(held, key=lambda k: (held[k]["completed"], k))
                del held[oldest]
                gone(oldest, "evicted")
            held[id_] = {"created": now, "completed": now, "busy": "", "version": 1}
            return "created"
        record = held.get(id_)
        if kind == "discard":
            held.pop(id_, None)
            return "discarded" if record else "ignored"
        if kind == "view":
            return "shown" if record else "unknown"
        if kind == "begin":
            if record is None:
                return "unknown"
            if record["busy"] not in ("", request):
                return "busy"
            record["busy"] = request
            return "accepted"
        if record is None or record["busy"] != request:  # of complete and fail
            return "ignored"
        record["busy"] = ""
        if kind == "complete":
            record["completed"], record["version"] = now, record["version"] + 1
            return "completed"
        return "released"


class Jobs(Keeper):
    """Searches by request: the same request joins the job it names, two run at once, one of them in depth; an ended job stays for a minute.

    An ended job takes no more events. Of a search in depth the newest of each kind of progress is replayed, and no more than 32 events and a megabyte are
    held: one event more ends it. kind: submit, submit_deep, resume, an event's type, error:<code>, done, or finish (its worker is free again).
    """

    def __init__(self, at_once: int = JOBS_AT_ONCE, kept: int = JOB_KEPT, most: int = REPLAY_EVENTS, most_bytes: int = REPLAY_BYTES):
        self.at_once, self.kept, self.most, self.most_bytes = at_once, kept * SECOND, most, most_bytes

    def ends(self, record: dict) -> int | None:
        return None if record["ended"] is None else record["ended"] + self.kept

    def step(self, held, kind, id_, request, size, now, gone):
        record = held.get(id_)
        if kind in ("submit", "submit_deep", "resume"):
            if record is not None:
                return f"joined:{len(record['replay'])}" if request == record["request"] or not request else "conflict"
            if kind == "resume":
                return "not_found"
            if kind == "submit_deep" and any(r["deep"] and r["state"] == "running" for r in held.values()):
                return "deep_busy"
            if sum(not r["released"] for r in held.values()) >= self.at_once:
                return "server_busy"
            held[id_] = {"request": request, "deep": kind == "submit_deep", "state": "running", "ended": None, "released": False, "replay": []}
            return "started"
        if record is None:
            return "ignored"
        if kind == "finish":
            was, record["released"] = record["released"], True
            return "ignored" if was else "freed"
        if record["state"] != "running":
            return "ignored"
        replay = list(record["replay"])
        if record["deep"]:
            if kind in LATEST_ONLY:
                replay = [e for e in replay if e[0] != kind]
            if len(replay) >= self.most or sum(e[1] for e in replay) + size > self.most_bytes:
                record.update(replay=[["error:result_too_large", 0]], state="failed", ended=now)
                return "failed"
        record["replay"] = [*replay, [kind, size]]
        if kind == "done" or kind.startswith("error"):
            record.update(state="completed" if kind == "done" else "cancelled" if kind == "error:cancelled" else "failed", ended=now)
            return record["state"]
        return "sent"


class Talks(Keeper):
    """Conversations: half an hour without a touch ends one that isn't answering; of 16, and of 64 MB in all, the one untouched for longest gives way
    unless it is answering; a turn under way reserves 2 MB; 8 MB fill a conversation.

    kind: new, view, start (request, size unused), finish (request, size in bytes of the turn).
    """

    closed = True

    def __init__(self, limit: int = CONVERSATIONS, idle: int = CONVERSATION_IDLE, most: int = CONVERSATION_BYTES, most_all: int = ALL_BYTES, reserve: int = TURN_RESERVE):
        self.limit, self.idle, self.most, self.most_all, self.reserve = limit, idle * SECOND, most, most_all, reserve

    def ends(self, record: dict) -> int | None:
        return None if record["active"] else record["touched"] + self.idle

    def _room(self, held, extra: int, new: int, spared: str, gone) -> bool:
        """Lets the longest untouched go until there is room."""
        size = sum(r["size"] + (self.reserve if r["active"] else 0) for r in held.values())
        free = sorted((r["touched"], k) for k, r in held.items() if not r["active"] and k != spared)
        while size + extra > self.most_all or len(held) + new > self.limit:
            if not free:
                return False
            _, k = free.pop(0)
            size -= held.pop(k)["size"]
            gone(k, "evicted")
        return True

    def step(self, held, kind, id_, request, size, now, gone):
        record = held.get(id_)
        if kind == "new":
            if record is not None or not self._room(held, BASE_BYTES, 1, "", gone):
                return "ignored" if record is not None else "server_busy"
            held[id_] = {"touched": now, "size": BASE_BYTES, "active": "", "requests": []}
            return "created"
        if record is None:
            return "not_found" if kind != "finish" else "ignored"
        if kind == "finish":
            if record["active"] != request:
                return "ignored"
            record.update(active="", touched=now, size=record["size"] + min(size, self.reserve - 256) + 256, requests=[*record["requests"], request])
            return "answered"
        record["touched"] = now
        if kind == "view":
            return "shown"
        if record["active"] == request or request in record["requests"]:
            return "joined"
        if record["active"]:
            return "conflict"
        if record["size"] + self.reserve > self.most:
            return "full"
        if not self._room(held, self.reserve, 0, id_, gone):
            return "server_busy"
        record["active"] = request
        return "started"


class Statuses(Keeper):
    """The state of an index job, changed only by allowed steps: cancelling ends in cancelled, and an ended job only starts anew.
    kind: the new state. A job that isn't heard of for `idle` seconds is forgotten."""

    def __init__(self, idle: int):
        self.idle = idle * SECOND

    def ends(self, record: dict) -> int:
        return record["at"] + self.idle

    def step(self, held, kind, id_, request, size, now, gone):
        record = held.get(id_)
        if record is not None:
            before = record["state"]
            ended = before in ("ready", "cancelled", "failed")
            refused = before == "cancelling" and kind not in ("cancelling", "cancelled") or ended and kind not in (before, "building")
            if refused:
                record["at"] = now
                return "refused"
        held[id_] = {"state": kind, "at": now}
        return "taken"


def kept_by(keeper: Keeper, events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The answers of a store to a stream of events (owner, ts, event_id, kind, id, request, size), and what was evicted or ran out (event_id -1)."""
    rows = events.withWatermark("ts", late).select("owner", "ts", F.unix_micros("ts").alias("us"), "event_id", "kind", "id", F.coalesce("request", F.lit("")).alias("request"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    return rows.groupBy("owner").transformWithStateInPandas(keeper, OUT, "append", "eventTime")
