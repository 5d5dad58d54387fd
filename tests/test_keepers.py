"""Stores of confirmations, jobs, conversations and states: their rules by hand, and the stream against a replay."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import jobs, keepers

MINUTE = 60 * keepers.SECOND


def replay(keeper, events):
    """Answers to (us, event_id, kind, id, request, size) of one owner, in that order, and all that went."""
    held, clock, out = {}, 0, []
    for us, event_id, kind, id_, request, size in sorted(events):
        clock = max(clock, us)
        gone = lambda other, why: out.append((-1, other, why))
        keeper._purge(held, clock, gone)
        answer = keeper.step(held, kind, id_, request, size, clock, gone)
        if answer:
            out.append((event_id, id_, answer))
    return out, held


def told(keeper, *steps):
    """Answers to steps (minute, kind, id, request, size)."""
    events = []
    for n, (minute, kind, id_, *rest) in enumerate(steps):
        request, size = [*rest, "", 0][:2] if len(rest) != 1 else (rest[0], 0)
        events.append((int(minute * MINUTE), n, kind, id_, request, size))
    return [x[2] for x in replay(keeper, events)[0]]


def test_confirmations_end_by_idleness_and_by_age():
    c = keepers.Confirmations()
    assert told(c, (0, "create", "a"), (30, "view", "a"), (30.1, "view", "a")) == ["created", "shown", "expired", "unknown"]
    steps = [(0, "create", "a")] + [(m, k, "a", "r") for m in range(20, 121, 20) for k in ("begin", "complete")]
    assert told(c, *steps, (121, "begin", "a", "r"))[-3:] == ["completed", "expired", "unknown"]  # two hours after it was asked
    assert told(c, (0, "create", "a"), (1, "begin", "a", "r"), (2, "begin", "a", "s"), (3, "begin", "a", "r"), (4, "complete", "a", "s"), (5, "fail", "a", "r"), (6, "begin", "a", "s"), (7, "complete", "a", "s"), (8, "discard", "a"), (9, "discard", "a")) == ["created", "accepted", "busy", "accepted", "ignored", "released", "accepted", "completed", "discarded", "ignored"]


def test_the_confirmation_untouched_for_longest_gives_way():
    c = keepers.Confirmations(limit=2)
    got = replay(c, [(i * MINUTE, i, kind, id_, "r", 0) for i, (kind, id_) in enumerate([("create", "a"), ("create", "b"), ("begin", "a"), ("complete", "a"), ("create", "c"), ("view", "a"), ("view", "b")])])[0]
    assert [x[1:] for x in got] == [("a", "created"), ("b", "created"), ("a", "accepted"), ("a", "completed"), ("b", "evicted"), ("c", "created"), ("a", "shown"), ("b", "unknown")]


def test_jobs_join_conflict_and_wait():
    j = keepers.Jobs()
    assert told(j, (0, "submit", "a", "q1"), (1, "status", "a"), (2, "submit", "a", "q1"), (3, "submit", "a", "q2"), (4, "submit_deep", "b", "q"), (5, "submit_deep", "c", "q"), (6, "submit", "c", "q"), (7, "resume", "c", "q")) == ["started", "sent", "joined:1", "conflict", "started", "deep_busy", "server_busy", "not_found"]
    assert told(j, (0, "submit", "a", "q"), (1, "done", "a"), (1.1, "status", "a"), (1.2, "finish", "a"), (1.3, "finish", "a"), (1.9, "resume", "a", "q"), (2.1, "resume", "a", "q")) == ["started", "completed", "ignored", "freed", "ignored", "joined:1", "expired", "not_found"]
    assert told(j, (0, "submit", "a", "q"), (1, "error:cancelled", "a")) == ["started", "cancelled"] and told(j, (0, "submit", "a", "q"), (1, "error:x", "a")) == ["started", "failed"]


def test_replay_of_a_deep_search_is_bounded():
    j = keepers.Jobs(most=3)
    events = [(n, n, kind, "a", "q", 10) for n, kind in enumerate(["submit_deep", "status", "text", "status", "status", "text", "text", "text"])]
    out, held = replay(j, events)
    assert [x[2] for x in out] == ["started", "sent", "sent", "sent", "sent", "sent", "failed", "ignored"]
    assert held["a"]["replay"] == [["error:result_too_large", 0]]
    big = keepers.Jobs(most_bytes=100)
    assert [x[2] for x in replay(big, [(0, 0, "submit_deep", "a", "q", 0), (1, 1, "text", "a", "", 100), (2, 2, "text", "a", "", 1)])[0]] == ["started", "sent", "failed"]


def test_conversations_keep_to_their_bounds():
    t = keepers.Talks(limit=2)
    assert told(t, (0, "new", "a"), (29.9, "view", "a"), (59.9, "view", "a")) == ["created", "shown", "expired", "not_found"]
    assert told(t, (0, "new", "a"), (1, "start", "a", "r"), (90, "view", "a"), (91, "finish", "a", "r"), (120.9, "start", "a", "r"), (151, "view", "a")) == ["created", "started", "shown", "answered", "joined", "expired", "not_found"]
    assert told(t, (0, "new", "a"), (1, "new", "b"), (2, "start", "a", "r"), (3, "new", "c"), (4, "start", "c", "r"), (5, "new", "d"), (6, "start", "a", "s")) == ["created", "created", "started", "evicted", "created", "started", "server_busy", "conflict"]
    full = keepers.Talks(most=3 << 20)
    assert [x[2] for x in replay(full, [(0, 0, "new", "a", "", 0), (1, 1, "start", "a", "r", 0), (2, 2, "finish", "a", "r", 9 << 20), (3, 3, "start", "a", "s", 0)])[0]] == ["created", "started", "answered", "full"]
    tight = keepers.Talks(most_all=(2 << 20) + 3000)
    assert told(tight, (0, "new", "a"), (1, "new", "b"), (2, "start", "a", "r"), (3, "start", "b", "r"), (4, "new", "c")) == ["created", "created", "started", "server_busy", "evicted", "created"]


@pytest.mark.parametrize("store", ["confirmations", "jobs", "conversations"])
def test_a_stream_in_many_batches_answers_as_a_replay(spark, tmp_path, store):
    keeper, kinds, ids = jobs.STORES[store]
    rng, rows = random.Random(len(store)), []
    for n in range(600):
        rows.append((str(rng.randrange(4)), n * 3600 * keepers.SECOND + rng.randrange(1000), n, rng.choice(list(kinds.values())), f"i{rng.randrange(ids)}", str(rng.randrange(2)), rng.randrange(3) << 20))
    rows += [("9", 3600 * keepers.SECOND, 1000, list(kinds.values())[0], "alone", "", 0)]  # doesn't come back
    frame = spark.createDataFrame(rows, "owner string, us long, event_id long, kind string, id string, request string, size long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    for part in range(6):
        frame.where((F.col("event_id") >= part * 100) & (F.col("event_id") < (part + 1) * 100) | (F.lit(part == 0) & (F.col("event_id") == 1000))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.conf.set(jobs.PROVIDER, keepers.ROCKSDB)
    seen = []
    query = keepers.kept_by(keeper(), stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda b, n: seen.extend(b.collect())).start()
    query.awaitTermination()
    spark.conf.unset(jobs.PROVIDER)
    for owner in "0123":
        want, held = replay(keeper(), [r[1:] for r in rows if r[0] == owner])
        got = [(r.event_id, r.id, r.outcome) for r in seen if r.owner == owner]
        assert sorted(x for x in got if x[0] >= 0) == sorted(x for x in want if x[0] >= 0)
        went = lambda out: sorted(x for x in out if x[0] < 0 and x[2] == "evicted")
        assert went(got) == went(want)
        # What ran out by the end of the watermark has gone, whether its owner came back or not.
        assert len([x for x in got if x[2] == "expired"]) >= len([x for x in want if x[2] == "expired"])
    alone = [r.outcome for r in seen if r.owner == "9"]
    if store != "jobs":
        assert alone[-1] == "expired"  # by its timer
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 60


def test_state_is_what_json_holds():
    for keeper in (keepers.Confirmations(), keepers.Jobs(), keepers.Talks(), keepers.Statuses(10)):
        kinds = ["create", "new", "submit_deep", "begin", "start", "status", "complete", "finish", "done"]
        held = replay(keeper, [(n, n, k, "a", "r", 1) for n, k in enumerate(kinds)])[1]
        assert json.loads(json.dumps(held)) == held
