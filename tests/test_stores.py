"""Files, registry, streams: what is new, what is kept, and that a replay adds nothing."""

import os
import shutil
from datetime import datetime

from pyspark.sql import functions as F

from loresmith.operators import registry as reg
from loresmith.sources import files, stores
from loresmith.streaming import streams


def tree(tmp_path):
    root = tmp_path / "raw"
    for folder, name, data in (
        ("guide", "a.md", "# 절차\n하나\n둘".encode()),
        ("guide", "copy.md", "# 절차\n하나\n둘".encode()),
        ("slack_manual", "t.txt", "[09:12] kim: 안녕 hello".encode()),
        ("kakao", "c.txt", "[이수] [오전 9:05] hi".encode("cp949")),
        ("misc", "b.txt", b"\xff plain"),
        ("other", "x.TXT", b"other"),
        ("misc", "skip.pdf", b"no"),
        ("misc", ".hidden.txt", b"no"),
        ("misc", "empty.txt", b"  "),
    ):
        os.makedirs(root / folder, exist_ok=True)
        (root / folder / name).write_bytes(data)
    return str(root)


def test_discovery_and_decoding(spark, tmp_path):
    root = tree(tmp_path)
    found = {r["file_name"]: r for r in files.discover_files(spark, root).collect()}
    assert set(found) == {"a.md", "copy.md", "t.txt", "c.txt", "b.txt", "x.TXT", "empty.txt"}
    assert found["t.txt"]["uploaded_category"] == "slack" and found["x.TXT"]["uploaded_category"] == "misc"
    assert found["a.md"]["file_stem"] == "a" and found["a.md"]["file_ext"] == "md"
    docs = {r["file_name"]: r for r in files.load_documents(files.read_files(spark, root), root).collect()}
    assert docs["c.txt"]["encoding"] == "cp949" and docs["c.txt"]["text"].startswith("[이수]")
    assert docs["b.txt"]["encoding"] == "latin-1" and docs["a.md"]["encoding"] == "utf-8"
    assert docs["a.md"]["document_id"] == docs["copy.md"]["document_id"] and docs["t.txt"]["source_type"] == "slack_manual"


def test_incremental_ingest_twice(spark, tmp_path):
    root, target = tree(tmp_path), str(tmp_path / "kb")
    streams.incremental_ingest(spark, root, target, str(tmp_path / "cp1"), 2026).awaitTermination()
    chunks = spark.read.parquet(f"{target}/chunks")
    once = chunks.count()
    assert once == chunks.select("chunk_id").distinct().count() == 5
    log = {r["status"]: r["n"] for r in spark.read.parquet(f"{target}/log").groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert log == {"indexed": 5, "skipped": 2}  # the copy and the empty file
    # A second run from an empty checkpoint sees every file again; a later file arrives as well.
    with open(f"{root}/misc/new.txt", "w") as f:
        f.write("brand new")
    streams.incremental_ingest(spark, root, target, str(tmp_path / "cp2"), 2026).awaitTermination()
    spark.catalog.refreshByPath(f"{target}/chunks")
    assert spark.read.parquet(f"{target}/chunks").count() == once + 1
    counted = streams.ingest_totals(spark, target).first()
    assert counted == reg.ingest_summary(spark.read.parquet(f"{target}/log")).first()
    assert counted.asDict() == {"total": 15, "indexed": 6, "skipped": 9, "failed": 0, "chunks_added": once + 1}
    assert spark.read.parquet(f"{target}/registry").select("file_hash").distinct().count() == 6


def test_replay_between_registry_and_log(spark, tmp_path):
    """The states are those of the batch, and a file without a decoder has its row."""
    root = tree(tmp_path)
    with open(f"{root}/misc/sheet.docx", "wb") as f:
        f.write(b"PK")
    states = []
    for turn in ("whole", "replayed"):
        target = str(tmp_path / turn)
        if turn == "replayed":  # everything but the log was written
            for name in ("chunks", "registry"):
                shutil.copytree(tmp_path / "whole" / name, tmp_path / turn / name)
        streams.ensure_table(spark, f"{target}/registry", streams.REGISTRY_SCHEMA)
        streams.ensure_table(spark, f"{target}/log", streams.LOG_SCHEMA)
        streams.ingest_batch(files.read_files(spark, root), 0, root, target, 2026, streams.CATEGORY_FOLDERS, "r")
        log = spark.read.schema(streams.LOG_SCHEMA).parquet(f"{target}/log")
        states.append(sorted((r["file_name"], r["status"], r["reason"] or "") for r in log.collect()))
    assert states[0] == states[1] and ("sheet.docx", "failed", "no decoder for .docx") in states[0]
    assert sum(status == "indexed" for _, status, _ in states[0]) == 5


def test_replayed_batch_adds_nothing(spark, tmp_path):
    root, target = tree(tmp_path), str(tmp_path / "kb")
    streams.ensure_table(spark, f"{target}/registry", streams.REGISTRY_SCHEMA)
    streams.ensure_table(spark, f"{target}/log", streams.LOG_SCHEMA)
    sizes = []
    for _ in range(2):
        streams.ingest_batch(files.read_files(spark, root), 0, root, target, 2026, streams.CATEGORY_FOLDERS, "r")
        sizes.append(tuple(spark.read.parquet(f"{target}/{t}").count() for t in ("chunks", "registry", "log", "batches/*")))
        assert streams.ingest_totals(spark, target).first() == reg.ingest_summary(spark.read.parquet(f"{target}/log")).first()
    assert sizes[0] == sizes[1] and sizes[0][-1] == 1


def test_counters_of_a_batch_without_files(spark, tmp_path):
    root, target = tree(tmp_path), str(tmp_path / "kb")
    streams.ensure_table(spark, f"{target}/registry", streams.REGISTRY_SCHEMA)
    streams.ensure_table(spark, f"{target}/log", streams.LOG_SCHEMA)
    streams.ingest_batch(files.read_files(spark, root).limit(0), 7, root, target, 2026, streams.CATEGORY_FOLDERS, "r")
    assert streams.batch_counters(spark, target).collect() == [("r", 7, 0, 0, 0, 0, 0)]


def test_question_stream_gates_and_cleans(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "u1", "c", "<@U1> 질문 하나 --debug"), (2, "u2", "c", "no"), (3, "u1", "c", "<@U1>  ")]
    schema = "query_id long, user string, channel string, text string"
    spark.createDataFrame(rows, schema).write.parquet(src)
    allowed = spark.createDataFrame([("u1",)], "user string")
    stream = spark.readStream.schema(schema).parquet(src)
    log = str(tmp_path / "log")
    streams.question_stream(stream, lambda q: q, log, str(tmp_path / "cp"), 100, allowed).awaitTermination()
    got = spark.read.parquet(log).collect()
    assert [(r["query_id"], r["question"], r["debug"]) for r in got] == [(1, "질문 하나", True)]


def test_usage_stream_equals_batch_on_closed_windows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(datetime(2026, 1, 1, h, 10), "k", float(h)) for h in range(6)]
    spark.createDataFrame(rows, "ts timestamp, kind string, value double").write.parquet(src)
    events = spark.readStream.schema("ts timestamp, kind string, value double").parquet(src)
    streams.usage_stream(events, out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out).select(F.hour("w.start").alias("h"), "calls", "total").orderBy("h").collect()
    assert [tuple(r) for r in got] == [(h, 1, float(h)) for h in range(4)]  # 4:10 is the watermark


def test_registry(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "n int, file_hash string")
    r = spark.createDataFrame([("a", "doc_a", 7)], "file_hash string, document_id string, chunk_count long")
    got = {x["n"]: (x["status"], x["known_document_id"], x["chunk_count"]) for x in reg.skip_indexed(f, r, "n").collect()}
    assert got == {1: ("skipped", "doc_a", 7), 2: ("new", None, None), 3: ("skipped", None, None), 4: ("new", None, None)}
    assert sorted(x["n"] for x in reg.work_list(f, r, [F.col("n")]).collect()) == [2, 4]


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "o", "d1"), (2, "o", "d2")], "chunk_id int, v string, document_id string")
    new = spark.createDataFrame([(2, "n", "d2"), (3, "n", "d3")], "chunk_id int, v string, document_id string")
    kept = {r["chunk_id"]: r["v"] for r in reg.upsert_index(old, new).collect()}
    assert kept == {1: "o", 2: "o", 3: "n"}
    assert {r["chunk_id"]: r["v"] for r in reg.upsert_index(old, new, False).collect()} == {1: "o", 2: "n", 3: "n"}
    assert reg.delete_by_document(old, spark.createDataFrame([("d1",)], "document_id string")).count() == 1


def test_worklist_batches(spark):
    rows = [(i, "" if i % 2 else f"e{i}", "", f"c{i % 50}") for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id int, embedding_text string, clean_content string, content string")
    empty = spark.createDataFrame([], "key string")
    work = reg.embedding_worklist(chunks, empty, "p", "m", "t", prefix=1)
    assert work.count() == work.select("key").distinct().count() == 100 + 25
    assert work.groupBy("batch_id").count().agg(F.max("count")).first()[0] <= 32
    assert reg.embedding_worklist(chunks, work.select("key"), "p", "m", "t").count() == 0


def test_json_chunks_skip_broken_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "guide", "x")], "chunk_id long, uploaded_category string, content string")
    path = str(tmp_path / "c")
    stores.write_chunks(df, path, "json")
    with open(f"{path}/uploaded_category=guide/bad.json", "w") as f:
        f.write('{"chunk_id": "no')
    assert [tuple(r) for r in stores.read_chunks(spark, path, df.schema, "json").select(*df.columns).collect()] == [(1, "guide", "x")]


def test_a_batch_without_new_files_cuts_nothing(spark, tmp_path, monkeypatch):
    root, target = tree(tmp_path), str(tmp_path / "kb")
    streams.incremental_ingest(spark, root, target, str(tmp_path / "cp1"), 2026).awaitTermination()
    monkeypatch.setattr(streams, "ingest_documents", lambda *_: 1 / 0)
    streams.incremental_ingest(spark, root, target, str(tmp_path / "cp2"), 2026).awaitTermination()
    spark.catalog.refreshByPath(f"{target}/log")
    log = spark.read.parquet(f"{target}/log")
    assert log.where("run = 'cp2'").select("status").distinct().collect() == [("skipped",)] and log.count() == 14
