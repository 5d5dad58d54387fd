"""Index builds that stop, resume, fail and replace one another."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import build
from tessera.operators.index import hashed_embedding


def model(name="m", mark=None, bad="", digest="1"):
    def call(texts):
        if bad and any(bad in t for t in texts):
            raise TimeoutError("too slow")
        return [[float(mark), *v[1:]] if mark is not None else v for v in hashed_embedding(texts)]

    return build.Model(name, digest, call)


def chunks(spark, texts, parts=3):
    rows = [(p, f"{p}#{i}", f"{t} part {i}") for p, t in texts.items() for i in range(parts)]
    made = spark.createDataFrame(rows, "path string, chunk_id string, text string").withColumn("text_sha256", F.sha2("text", 256))
    files = made.groupBy("path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("text")), "|"), 256).alias("file_sha256"))
    return made.join(files, "path").select(*build.CHUNK, "text")


TEXTS = {f"f{i}.md": f"text of file {i}" for i in range(8)}


@pytest.fixture
def kept(spark, tmp_path):
    return build.Index(spark, f"file://{tmp_path}/index")


def marks(index):
    return {r.chunk_id: r.m for r in index.entries().select("chunk_id", F.get("embedding", F.lit(0)).alias("m")).collect()}


def test_first_build_and_one_that_keeps_unchanged_files(spark, kept):
    assert kept.status(chunks(spark, TEXTS), model())["state"] == "missing"
    first = kept.build(chunks(spark, TEXTS), model(mark=1))
    assert (first["total"], first["dimension"]) == (24, 16) and kept.status(chunks(spark, TEXTS), model())["state"] == "ready"
    changed = {**{k: v for k, v in TEXTS.items() if k != "f7.md"}, "f0.md": "other words", "new.md": "new"}
    assert kept.status(chunks(spark, changed), model())["state"] == "stale"
    events = []
    kept.build(chunks(spark, changed), model(mark=2), progress=events.append)
    got = marks(kept)
    assert {k for k, m in got.items() if m == 2} == {f"{p}#{i}" for p in ("f0.md", "new.md") for i in range(3)} and len(got) == 24
    assert events[-1]["state"] == "ready" and events[-1]["reused"] == 18 and not kept.store.exists("building/" + events[-1]["generation"])
    kept.build(chunks(spark, changed), model(mark=3), mode="full")
    assert set(marks(kept).values()) == {3.0}
    kept.build(chunks(spark, changed), model(mark=4, digest="2"))  # other weights: nothing may be kept
    assert set(marks(kept).values()) == {4.0}
    assert len(kept.store.names("versions")) == 2  # the one in use and the one before


def test_a_stopped_build_resumes_and_the_old_index_stays_readable(spark, kept):
    kept.build(chunks(spark, TEXTS), model(mark=1))
    new = {k: v + " again" for k, v in TEXTS.items()}
    asked = []

    def stop():
        assert set(marks(kept).values()) == {1.0}  # readable at every step
        asked.append(1)
        return len(asked) > 2

    with pytest.raises(build.BuildError) as e:
        kept.build(chunks(spark, new), model(mark=2), batch_chunks=6, cancelled=stop)
    assert e.value.code == "CANCELLED" and set(marks(kept).values()) == {1.0}
    state = kept.status(chunks(spark, new), model())
    assert (state["state"], state["checkpointed"]) == ("cancelled", 2)
    kept.build(chunks(spark, new), model(mark=3), batch_chunks=6)
    values = list(marks(kept).values())
    assert set(values) == {2.0, 3.0} and len(values) == 24  # what was embedded before the stop was not embedded again
    assert kept.status(chunks(spark, new), model())["state"] == "ready"


def test_batches_of_another_mode_or_base_are_not_used(spark, kept):
    with pytest.raises(build.BuildError):
        kept.build(chunks(spark, TEXTS), model(mark=1), batch_chunks=6, cancelled=iter([False, False, True]).__next__)
    kept.build(chunks(spark, TEXTS), model(mark=2), mode="full", batch_chunks=6)
    assert set(marks(kept).values()) == {2.0}


def test_failed_vectors_leave_the_old_version_and_only_their_batches_are_made_again(spark, kept):
    kept.build(chunks(spark, TEXTS), model(mark=1))
    new = {k: v + (" poison" if k == "f3.md" else " fine") for k, v in TEXTS.items()}
    with pytest.raises(build.BuildError) as e:
        kept.build(chunks(spark, new), model(mark=2, bad="poison"), batch_chunks=4)
    assert e.value.code == "EMBEDDING_FAILED" and set(marks(kept).values()) == {1.0}
    assert kept.status(chunks(spark, new), model())["state"] == "failed"
    kept.build(chunks(spark, new), model(mark=3), batch_chunks=4)
    got = marks(kept)
    assert {got[f"f3.md#{i}"] for i in range(3)} == {3.0} and 2.0 in got.values()


def test_calls_that_fail_once_are_repeated_in_halves(spark):
    rows = chunks(spark, {"a.md": "good", "b.md": "poison"}, parts=4).coalesce(1).sortWithinPartitions("chunk_id")
    got = {r.chunk_id: r.embedding for r in build.embed_or_null(rows, model(bad="poison"), batch=8).collect()}
    assert all((v is None) == k.startswith("b.md") for k, v in got.items()) and len(got) == 8

    def short(texts):
        return [[1.0]] * (len(texts) - 1)

    assert all(r.embedding is None for r in build.embed_or_null(rows, build.Model("m", "1", short)).collect())

    def odd(texts):
        return [[float("nan")] if "0" in t else [] if "1" in t else [2.0] for t in texts]

    assert {r.chunk_id[-1] for r in build.embed_or_null(rows, build.Model("m", "1", odd)).where("embedding is not null").collect()} == {"2", "3"}

    def broken(texts):
        raise KeyError("a fault of the program")

    with pytest.raises(Exception, match="a fault of the program"):
        build.embed_or_null(rows, build.Model("m", "1", broken)).collect()


def test_a_source_that_changes_meanwhile_is_not_taken_into_use(spark, kept):
    kept.build(chunks(spark, TEXTS), model(mark=1))
    new = chunks(spark, {**TEXTS, "f0.md": "changed"})
    with pytest.raises(build.BuildError) as e:
        kept.build(new, model(mark=2), now=lambda: chunks(spark, {**TEXTS, "f0.md": "changed twice"}))
    assert e.value.code == "SOURCE_CHANGED" and set(marks(kept).values()) == {1.0} and len(kept.store.names("versions")) == 1
    kept.build(new, model(mark=2), now=lambda: new)
    assert 2.0 in marks(kept).values()


def test_vectors_of_several_sizes_are_not_taken_into_use(spark, kept):
    def sizes(texts):
        return [[1.0] * (1 + len(t) % 2) for t in texts]

    with pytest.raises(build.BuildError) as e:
        kept.build(chunks(spark, {"a.md": "x", "b.md": "xy"}), build.Model("m", "1", sizes))
    assert e.value.code == "INVALID" and kept.current() is None and kept.store.names("versions") == []


def test_one_writer_at_a_time(spark, kept):
    kept.store.create("lock", json.dumps({"since": time.time(), "owner": "other"}))
    with pytest.raises(build.BuildError) as e:
        kept.build(chunks(spark, TEXTS), model())
    assert e.value.code == "BUSY" and kept.store.exists("lock")
    kept.store.replace("lock", json.dumps({"since": time.time() - 99, "owner": "gone"}))
    header = kept.build(chunks(spark, TEXTS), model(), lock_seconds=50)
    assert not kept.store.exists("lock")
    kept.store.create("lock", json.dumps({"since": time.time(), "owner": "other"}))
    assert kept.build(chunks(spark, TEXTS), model()) == header  # nothing to do


def test_damage_is_seen_by_the_status(spark, kept):
    header = kept.build(chunks(spark, TEXTS), model())
    assert kept.differences(kept.entries().limit(20), chunks(spark, TEXTS), 16)["missing"] == 4
    short = kept.entries().withColumn("embedding", F.when(F.col("chunk_id") == "f0.md#0", F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding"))).collect()
    spark.createDataFrame(short, kept.entries().schema).coalesce(1).write.mode("overwrite").parquet(f"{kept.root}/{header['folder']}/entries")
    assert kept.status(chunks(spark, TEXTS), model())["state"] == "stale"
    assert kept.status(chunks(spark, TEXTS), model(), validate=False)["state"] == "ready"
    kept.build(chunks(spark, TEXTS), model(mark=9))
    assert {k for k, v in marks(kept).items() if v == 9} == {f"f0.md#{i}" for i in range(3)}


def test_an_empty_corpus_has_an_empty_index(spark, kept):
    kept.build(chunks(spark, TEXTS).limit(0), model())
    assert kept.entries().count() == 0 and kept.status(chunks(spark, TEXTS).limit(0), model())["state"] == "ready"
