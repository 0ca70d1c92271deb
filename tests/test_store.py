"""Commits, rollback, keyed upserts and the incremental ingest."""

import random

import pytest
from pyspark.sql import functions as F

from codelake.engine import Engine
from codelake.operators import graph
from codelake.sources.store import Conflict, Store
from codelake.streaming.limits import ingest_stream
from codelake.streaming.progress import BatchLog

TABLES = {"t": ("id string, v int", "id"), "u": ("id string", "id")}


def store(spark, tmp_path, buckets=16):
    return Store(spark, f"file://{tmp_path}/store", TABLES, buckets)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id string, v int")


def content(frame):
    return {r.id: r.v for r in frame.collect()}


def test_a_commit_is_all_or_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    with s.change("r") as change:
        change.replace("t", rows(spark, [("a", 1), ("b", 2)]))
        assert content(s.read("t", "r")) == {} and content(change.read("t")) == {"a": 1, "b": 2}  # not before the commit
        change.replace("u", spark.createDataFrame([("x",)], "id string"))
    assert change.metrics["t"]["rows"] == 2 and content(s.read("t", "r")) == {"a": 1, "b": 2}
    with pytest.raises(RuntimeError, match="between"), s.change("r") as change:
        change.replace("t", rows(spark, [("a", 9)]))
        raise RuntimeError("between two writes")
    assert content(s.read("t", "r")) == {"a": 1, "b": 2} and s.read("u").count() == 1 and s.versions("r") == [1]
    assert len(list((tmp_path / "store/t/repo_id=r").glob("version=*"))) == 1  # what failed is gone


def test_two_changes_at_once(spark, tmp_path):
    s = store(spark, tmp_path)
    with pytest.raises(Conflict), s.change("r") as late:
        late.replace("t", rows(spark, [("late", 1)]))
        with s.change("r") as first:
            first.replace("t", rows(spark, [("first", 1)]))
    assert content(s.read("t", "r")) == {"first": 1}


def test_an_upsert_writes_only_its_buckets(spark, tmp_path):
    s = store(spark, tmp_path, buckets=64)
    with s.change("r") as change:
        change.replace("t", rows(spark, [(f"k{i}", i) for i in range(500)]))
    before = s.head("r")[1]["t"]
    ids = [f"k{i}" for i in range(8)] + ["new1", "new2"]
    with s.change("r") as change:
        change.upsert("t", rows(spark, [(i, -1) for i in ids[:-1]]), spark.createDataFrame([("k9",), (None,)], "id string"))
    after = s.head("r")[1]["t"]
    assert change.metrics["t"]["buckets"] <= 10 and sum(before.get(b) != f for b, f in after.items()) <= 10
    want = {f"k{i}": i for i in range(500) if i != 9} | {i: -1 for i in ids[:-1]}
    assert content(s.read("t", "r")) == want
    assert content(s.read("t", "r", 1)) == {f"k{i}": i for i in range(500)}  # the former version is still there
    with s.change("r") as change:
        change.upsert("t", rows(spark, []), rows(spark, []).select("id"))
    assert content(s.read("t", "r")) == want
    assert s.restore("r", 1) == 4 and len(s.read("t", "r").collect()) == 500
    assert s.vacuum("r", keep=1) >= 1 and s.versions("r") == [4] and len(s.read("t", "r").collect()) == 500
    s.drop("r")
    assert s.repos() == [] and s.read("t").count() == 0


def code(names, calls):
    return "\n\n".join(f"def {n}(x):\n    a = 1\n    b = 2\n    return {' + '.join(f'{c}(x)' for c in calls)}\n" for n in names)


def batches(seed, count=5):
    """Batches of files and deletions over a few names that come and go."""
    rng = random.Random(seed)
    names = [f"fun{c}{c}{i}" for i in range(12) for c in "xy"]
    out, known = [], []
    for _ in range(count):
        batch = []
        for file in rng.sample([f"m{i}.py" for i in range(8)], 4):
            if file in known and rng.random() < 0.3:
                batch.append(("r", file, None, None, True))
                known.remove(file)
            else:
                text = code(rng.sample(names, rng.randint(1, 4)), rng.sample(names, 3)) if rng.random() < 0.9 else "def ("
                batch.append(("r", file, "python", text.encode(), False))
                known.append(file) if file not in known else None
        out.append(batch)
    return out


FILES = "repo_id string, file string, language string, content binary, deleted boolean"


def linked(engine):
    return {(r.src_uid, r.dst_uid) for r in engine.store.read("calls", "r").collect()}, {(r.src_uid, r.src_file, r.name) for r in engine.store.read("mentions", "r").collect()}


def anew(engine):
    e = engine.store.read("entities", "r")
    return {(r.src_uid, r.dst_uid) for r in graph.link_dependencies(e).collect()}, {(r.src_uid, r.src_file, r.name) for r in graph.mentions(e, graph.callable_names(e)).collect()}


def test_changed_files_are_linked_as_if_all_were(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "PART", 5)
    monkeypatch.setattr(graph, "BLOCK", 3)
    engine, files, some = Engine(spark, f"file://{tmp_path}/lake", buckets=4), {}, 0
    for batch in batches(3):
        frame = spark.createDataFrame(batch, FILES)
        engine.apply(frame)
        got = linked(engine)
        assert got == anew(engine)
        some += len(got[0])
        for _, file, _, text, deleted in batch:
            files.pop(file, None)
            if not deleted and text != b"def (":
                files[file] = text
        assert {r.file for r in engine.store.read("entities", "r").select("file").distinct().collect()} == set(files)
        assert {r.file for r in engine.store.read("chunks", "r").collect()} == set(files)
        engine.apply(frame, 1)  # the batch comes once more
        assert linked(engine) == got
    assert some > 10


def test_ingest_counts_while_it_writes(spark, tmp_path):
    seen = []
    (tmp_path / "src").mkdir()
    for name, text in {"a.py": code(["alpha", "beta"], ["gamma"]), "b.py": code(["gamma"], ["alpha"])}.items():
        (tmp_path / "src" / name).write_text(text)
    engine = Engine(spark, f"file://{tmp_path}/lake", progress=lambda *event: seen.append(event[:3]))
    counts = engine.ingest(str(tmp_path / "src"), "r")
    assert counts == {"entities": 3, "mentions": counts["mentions"], "calls": 3, "chunks": 3} == {t: engine.store.read(t, "r").count() for t in counts}
    assert [e[1] for e in seen] == ["entities", "mentions", "calls", "chunks"] and seen[0] == ("r", "entities", 3)
    one = engine.store.read("chunks", "r").limit(1).collect()[0]
    wrote = engine.upsert_chunks("r", spark.createDataFrame([one], engine.store.read("chunks").schema).withColumn("name", F.lit("renamed")))
    assert wrote["buckets"] == 1 and engine.store.read("chunks", "r").where("name = 'renamed'").count() == 1 and engine.store.read("chunks", "r").count() == 3


def test_a_stream_of_files(spark, tmp_path):
    engine, log = Engine(spark, f"file://{tmp_path}/lake", buckets=4), BatchLog(spark, f"file://{tmp_path}/progress")
    for i, batch in enumerate(batches(8, 2)):
        spark.createDataFrame(batch, FILES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.streams.addListener(log)
    query = ingest_stream(stream, engine.apply, f"{tmp_path}/checkpoint", available_now=True)
    try:
        assert query.awaitTermination(180)
    finally:
        query.stop()
        spark.streams.removeListener(log)
    assert linked(engine) == anew(engine) and engine.store.versions("r")[-1] == 2
    log.flush()
    batches_seen = log.read().collect()
    assert [r.batch for r in sorted(batches_seen, key=lambda r: r.batch)] == [0, 1] and sum(r.rows for r in batches_seen) == 8
