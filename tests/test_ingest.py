"""Message files through the stream into a store."""

import json
import os

import pandas as pd

from cubemerge.sources.store import Store
from cubemerge.streaming.ingest import Extractors, Ingest, write_messages

SCHEMA = {
    "COORDS": {"x": {"type": "int64"}}, "VARS": {"v": {"type": "float64", "coords": ["x"]}},
    "child": {"COORDS": {"x": {"type": "int64"}}, "VARS": {"v": {"type": "float64", "coords": ["x"]}}},
}


def message(name, content, **meta):
    return (name, content.encode(), json.dumps({"content_type": "text/csv", **meta}))


def test_ingest_and_replay(spark, tmp_path):
    queue = str(tmp_path / "queue")
    extractors = Extractors()
    extractors.csv("table", "x long, v double")
    extractors.json_records("records", "x long, v double")
    extractors.register_python("doubled", lambda payload, meta: pd.DataFrame(
        {"x": [int(payload.decode())], "v": [2.0 * float(meta["dataframe_row"]["factor"])]}), "x long, v double")
    store = Store.open(spark, str(tmp_path / "store"), SCHEMA)
    ingest = Ingest(store, queue, extractors, {"csv": "table", "json": "records"})
    put = lambda rows: write_messages(spark.createDataFrame(rows, "name string, content binary, metadata string"), queue)
    run = lambda: ingest.start(str(tmp_path / "checkpoint"), once=True).awaitTermination()

    put([
        message("1.csv", "x,v\n1,10\n2,20\n", target_node=""),
        message("2.csv", "x,v\n2,21\n", target_node=""),
        message("3.json", '[{"x": 7, "v": 0.5}]', content_type="application/json", node_path="/child"),
        message("4.json", '{"x": 7', content_type="application/json", node_path="child"),
        message("5.csv", "", target_node=""),
        message("6.csv", "x,v\n1,1\n", node_path="../child"),
        message("7.csv", "x,v\n1,1\n", node_path="nowhere"),
        message("8.csv", "5", node_path="child", extract_fn="doubled", dataframe_row={"factor": "3"}),
        message("9.csv", "five", node_path="child", extract_fn="doubled", dataframe_row={"factor": "3"}),
        message("a.html", "<p>", content_type="text/html"),
    ])
    run()
    read = lambda path: {r["x"]: r["v"] for r in store.node(path).read_df("v").collect()}
    # the later file wins for x = 2
    assert read("") == {1: 10.0, 2: 21.0}
    assert read("child")[7] == 0.5
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in ingest.failed().collect()}
    assert reasons["4.json"] == "invalid JSON"
    assert reasons["5.csv"] == "empty payload"
    assert reasons["6.csv"] == "invalid node path"
    assert reasons["7.csv"] == "unknown node"
    assert reasons["a.html"] == "unsupported content type"
    assert "9.csv" in reasons and "8.csv" not in reasons
    assert {r["type"]: r["n"] for r in ingest.failures().collect()}["empty payload"] == 1

    # a second run takes only new files; a missing sidecar is reported
    # columns by name, more of them than asked for, quoted line ends; lines that do not fit are dropped
    put([message("b.csv", 'v,note,x\n30,"a\nb, c",3\n31,5\nten,,6\n', target_node="")])
    put([message("bb.csv", "x,w\n9,1\n", target_node="")])
    (tmp_path / "queue" / "c.csv").write_text("x,v\n4,40\n")
    run()
    assert read("") == {1: 10.0, 2: 21.0, 3: 30.0}
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in ingest.failed().collect()}["c.csv"] == "no metadata"
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in ingest.failed().collect()}["bb.csv"] == "columns not in the header: ['v']"

    # once the metadata is there, a replay merges the message
    (tmp_path / "queue" / "c.csv.meta.json").write_text(json.dumps({"content_type": "text/csv", "target_node": ""}))
    assert ingest.replay() == 8
    assert read("")[4] == 40.0
    assert ingest.replay() == 7
    # nothing of a batch stays in the scratch folder
    scratch = spark.conf.get("spark.checkpoint.dir") + "/cubemerge"
    left = [n for n in os.listdir(scratch) if n.split("-")[0] in ("batch", "messages", "rows", "update", "cells", "replay")]
    before = set(left)
    assert ingest.replay() == 7
    assert {n for n in os.listdir(scratch) if n.split("-")[0] in ("batch", "messages", "rows", "update", "cells", "replay")} <= before


def tables(spark, tmp_path, **options):
    extractors = Extractors()
    extractors.csv("table", "x long, v double")
    store = Store.open(spark, str(tmp_path / "store"), SCHEMA)
    return Ingest(store, str(tmp_path / "queue"), extractors, {"csv": "table"}, **options)


def cells(store, node=""):
    return {r["x"]: r["v"] for r in store.node(node).read_df("v").collect()}


FILES = "path string, content binary"


def test_sidecars_and_data_meet_across_batches(spark, tmp_path):
    feed = tables(spark, tmp_path)
    meta = json.dumps({"content_type": "text/csv"}).encode()
    batch = lambda rows, n: feed.process(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], FILES), n)
    (tmp_path / "queue").mkdir()
    batch([("q/a.csv", b"x,v\n4,4\n"), ("q/b.csv.meta.json", meta)], 0)
    assert {r["path"]: r["reason"] for r in feed.failed().collect()} == {"q/a.csv": "no metadata", "q/b.csv": "empty payload"}
    # nothing of the two comes in the next batch; the one after completes both
    batch([("q/c.csv", b"x,v\n3,3\n"), ("q/c.csv.meta.json", meta)], 1)
    batch([("q/a.csv.meta.json", meta), ("q/b.csv", b"x,v\n5,5\n")], 2)
    assert cells(feed.store) == {3: 3.0, 4: 4.0, 5: 5.0}
    # a batch delivered again changes nothing and adds no failures
    count = feed.failed().count()
    batch([("q/a.csv.meta.json", meta), ("q/b.csv", b"x,v\n5,5\n")], 2)
    assert cells(feed.store) == {3: 3.0, 4: 4.0, 5: 5.0} and feed.failed().count() == count
    assert feed._waiting(3).count() == 0 and feed.replay() == 0


def test_tasks_do_not_grow_with_the_files(spark, tmp_path):
    feed = tables(spark, tmp_path)
    put = [message(f"{i:04}.csv", f"x,w\n{i},1\n" if i % 50 == 7 else f"v,x\n{i}.5,{i}\n\n{i},1,2\n") for i in range(400)]
    write_messages(spark.createDataFrame(put, "name string, content binary, metadata string"), str(tmp_path / "queue"))
    stream = feed.start(str(tmp_path / "checkpoint"), once=True)
    stream.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(stream.runId))]
    widest = max(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if tracker.getStageInfo(s))
    # 400 data files and as many sidecars
    assert widest <= 4 * spark.sparkContext.defaultParallelism
    assert cells(feed.store) == {i: i + 0.5 for i in range(400) if i % 50 != 7} and feed.failed().count() == 8


def test_the_driver_keeps_no_list_of_files(spark, tmp_path):
    feed = tables(spark, tmp_path)
    put = [message(f"{i:04}.csv", f"x,v\n{i},{i}\n") for i in range(150)]
    write_messages(spark.createDataFrame(put, "name string, content binary, metadata string"), str(tmp_path / "queue"))
    feed.start(str(tmp_path / "checkpoint"), once=True).awaitTermination()
    # what the stream's source remembers: one entry for the batch, not for each of 300 files
    logs = [f for f in (tmp_path / "checkpoint" / "sources").rglob("*") if f.is_file() and not f.name.endswith(".crc")]
    assert sum(f.read_text(errors="replace").count('"path"') for f in logs) == 1
    assert cells(feed.store) == {i: float(i) for i in range(150)}


def test_files_are_listed_once_and_oldest_first(spark, tmp_path):
    from cubemerge.streaming.listing import Listing, found, mounted

    def put(name, age, content="x"):
        (tmp_path / "queue" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "queue" / name).write_text(content)
        os.utime(tmp_path / "queue" / name, (1_700_000_000 - age, 1_700_000_000 - age))

    files = {"b.csv": 30, "a/deep/c.csv": 50, "d=1/_x=2.csv": 10, "e é.csv": 40, "f.csv": 20, "old.csv": 30 * 86400}
    for name, age in files.items():
        put(name, age, "" if name == "f.csv" else name)
    for name in (".g.csv.tmp", "_h.csv", "_i/j.csv", ".k/l.csv", "m._COPYING_"):
        put(name, 0)
    os.symlink(tmp_path / "nowhere", tmp_path / "queue" / "n.csv")
    folder = mounted(spark, f"file://{tmp_path}/queue/")
    assert folder == f"{tmp_path}/queue" and mounted(spark, f"{tmp_path}/q*") is None and mounted(spark, f"{tmp_path}/none") is None
    # the same files as Spark's source finds
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    assert {(r.path, r.modificationTime) for r in theirs.collect()} == {(r.path, r.modificationTime) for r in found(spark, folder).collect() if not r.path.endswith("f.csv")}

    root = str(tmp_path / "listing")
    read = lambda listing, batch: {r.path.split("/queue/")[1]: r.content.decode() for r in listing.read(spark, batch).collect()}
    listing = Listing(spark, folder, root, 2)
    assert listing.extend() == 3 and listing.extend() == 0
    assert [read(listing, k) for k in range(3)] == [{n: n for n in some} for some in (["old.csv", "a/deep/c.csv"], ["e é.csv", "b.csv"], ["d=1/_x=2.csv"])]
    # a file of a listed name is not taken again, nor one that is too old; what a failed listing left goes
    put("b.csv", 0, "new")
    put("o.csv", 8 * 86400)
    put("p.csv", 5, "p.csv")
    (tmp_path / "listing" / "files" / "batch=3").mkdir()
    (tmp_path / "listing" / "files" / "batch=3" / "part-0.parquet").write_text("no parquet")
    again = Listing(spark, folder, root, 2)
    assert again.extend() == 1 and read(again, 3) == {"p.csv": "p.csv"} and read(again, 0).keys() == {"old.csv", "a/deep/c.csv"}


def test_a_running_stream_takes_new_files(spark, tmp_path):
    import time

    feed = tables(spark, tmp_path)
    put = lambda i: write_messages(spark.createDataFrame([message(f"{i}.csv", f"x,v\n{i},{i}\n")], "name string, content binary, metadata string"), str(tmp_path / "queue"))
    put(1)
    query = feed.start(str(tmp_path / "checkpoint"), every="interval 1 second")
    put(2)
    until = time.time() + 120
    while time.time() < until and query.isActive and feed.done().where("accepted").count() < 2:
        time.sleep(1)
    query.stop()
    assert query.exception() is None and cells(feed.store) == {1: 1.0, 2: 2.0}


def test_waiting_files_are_given_up(spark, tmp_path):
    feed = tables(spark, tmp_path, patience="0 seconds")
    (tmp_path / "queue").mkdir()
    feed.process(spark.createDataFrame([("q/a.csv", bytearray(b"x,v\n1,1\n"))], FILES), 0)
    assert feed._waiting(1).count() == 0 and feed.failed().count() == 1


def test_bad_messages_of_many_in_a_fixed_number_of_jobs(spark, tmp_path):
    def run(name, n):
        feed = tables(spark, tmp_path / name)
        bad = lambda i: i % 100 == 7
        rows = [(f"m{i:04}.csv", bytearray(f"x,w\n{i},1\n".encode() if bad(i) else f"x,v\n{i},{i}\n".encode()), json.dumps({"content_type": "text/csv"})) for i in range(n)]
        started = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
        before = started()
        feed.process_rows(spark.createDataFrame(rows, "name string, content binary, metadata string"), 0)
        jobs = started() - before
        assert len(cells(feed.store)) == n - sum(map(bad, range(n))) and feed.failed().count() == sum(map(bad, range(n)))
        return jobs

    few, many = run("few", 100), run("many", 1000)
    assert many <= few + 3


def test_an_extractor_that_raises_is_narrowed_down(spark, tmp_path):
    feed = tables(spark, tmp_path)

    def strict(messages):
        from pyspark.sql import functions as F

        # fails as a job on text that is no number
        return messages.select("path", F.col("content").cast("string").cast("long").alias("x"), F.lit(1.0).alias("v"))

    feed.extractors.functions["strict"] = strict
    meta = json.dumps({"content_type": "text/csv", "extract_fn": "strict"})
    rows = [(f"m{i}", bytearray(b"no" if i == 5 else str(i).encode()), meta) for i in range(8)]
    spark.conf.set("spark.sql.ansi.enabled", "true")
    feed.process_rows(spark.createDataFrame(rows, "name string, content binary, metadata string"), 0)
    assert set(cells(feed.store)) == {0, 1, 2, 3, 4, 6, 7}
    assert [r["path"] for r in feed.failed().collect()] == ["m5"]


def test_messages_choose_their_schema(spark, tmp_path):
    other = Store.open(spark, str(tmp_path / "other"), {"COORDS": {"x": {"type": "int64"}}, "VARS": {"v": {"type": "float64", "coords": ["x"]}}})
    feed = tables(spark, tmp_path, schemas={"other.yaml": other})
    put = [message(f"{i}.csv", f"x,v\n{i},{i}\n", **more) for i, more in enumerate([{}, {"schema_path": "other.yaml"}, {"schema_path": "none.yaml"}, {"schema_path": "other.yaml", "target_node": "child"}, {"target_node": "child"}])]
    feed.process_rows(spark.createDataFrame(put, "name string, content binary, metadata string"), 0)
    assert (cells(feed.store), cells(feed.store, "child"), cells(other)) == ({0: 0.0}, {4: 4.0}, {1: 1.0})
    assert {r["path"]: r["reason"] for r in feed.failed().collect()} == {"2.csv": "unknown schema", "3.csv": "unknown node"}


def test_a_queue_of_rows(spark, tmp_path):
    from cubemerge.streaming.ingest import append_messages

    feed = tables(spark, tmp_path)
    shape = "name string, content binary, metadata string"
    put = lambda rows: append_messages(spark.createDataFrame(rows, shape), str(tmp_path / "queue"))
    run = lambda: feed.start_rows(str(tmp_path / "checkpoint"), once=True).awaitTermination()
    put([message("1.csv", "x,v\n1,10\n"), message("2.csv", "x,v\n2,21\n"), ("3.csv", None, json.dumps({"content_type": "text/csv"}))])
    run()
    put([message("4.csv", "x,v\n1,11\n"), message("5.csv", "x,w\n1,11\n")])
    run()
    assert cells(feed.store) == {1: 11.0, 2: 21.0}
    assert feed.replay() == 2 and feed.replay() == 2
    # replays have their own batch numbers
    assert {(r["run"], r["batch"]) for r in feed.done().select("run", "batch").distinct().collect()} == {("stream", 0), ("stream", 1), ("replay", 1), ("replay", 2)}
