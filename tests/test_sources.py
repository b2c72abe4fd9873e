"""Round trips of every source and sink over files."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarryline.operators import records
from quarryline.sources import logs, sinks, stores


@pytest.fixture
def store(tmp_path):
    for folder in ("refs", "manifests", "indexes"):
        (tmp_path / folder).mkdir()
    for sha, n in (("aa", 3), ("bb", 5)):
        (tmp_path / "manifests" / f"{sha}.json").write_text(json.dumps({"size_bytes": n, "chunk_graph": {"chunk_count": n - 2}}))
    (tmp_path / "refs" / "model-v1.0.json").write_text(json.dumps({"artifact_id": "ak://sha256:aa"}))
    (tmp_path / "refs" / "lost.json").write_text(json.dumps({"artifact_id": "ak://sha256:zz"}))
    (tmp_path / "refs" / "broken.json").write_text("{")
    (tmp_path / "indexes" / "blake3-cc.json").write_text(json.dumps({"manifest_path": "/x/manifests/bb.json"}))
    return str(tmp_path)


def test_addresses_resolve_to_manifests(spark, store):
    want = {"ak://sha256:aa": "aa", "ak://sha256:qq": None, "ak://blake3:cc": "bb", "ak://blake3:dd": None, "model@v1.0": "aa", "lost": None, "broken": None}
    a = spark.createDataFrame([(k,) for k in want], "address string")
    assert {r.address: r.manifest for r in stores.resolved(a, store, "address").collect()} == want
    assert sorted((r.sha, r.size_bytes, r.chunk_count) for r in stores.manifests(spark, store).collect()) == [("aa", 3, 1), ("bb", 5, 3)]
    assert stores.references(spark, store).count() == 2


def test_document_stores(spark, tmp_path):
    (tmp_path / "a.embed.json").write_text(json.dumps({"vector": [1.0, 2.0], "residual_norm": 0.5}))
    (tmp_path / "b.embed.json").write_text(json.dumps({"id": "no vector"}))
    (tmp_path / "c.artifact.json").write_text(json.dumps({"artifact_id": "sha256:1", "name": "n", "type": "t"}))
    assert [tuple(r) for r in stores.embeddings(spark, str(tmp_path)).collect()] == [("a", [1.0, 2.0], None, 0.5)]
    found = records.entity_matches(stores.artifacts(spark, str(tmp_path)), "sha", "name", "artifact_id").collect()
    assert [(r.artifact_id, r.emitted_at) for r in found] == [("sha256:1", None)]


def test_meter_files_of_one_model(spark, tmp_path):
    for name, at in (("m1.a", "2024-01-02T00:00:00Z"), ("m1.b", "2023-01-01T00:00:00Z"), ("m10.a", "2024-01-02T00:00:00Z")):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"recorded_at": at}) + "\n")
    count = lambda *a: stores.meter_of(spark, str(tmp_path), *a).count()
    assert (count(), count("m1"), count("m1", "2024-01-01"), count("m10")) == (3, 2, 1, 1)


def test_newest_file(spark, tmp_path):
    for i, name in enumerate(("x", "y", "z")):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (1000 - i, 1000 - i))
    assert [r.path[-1] for r in stores.newest(spark, str(tmp_path)).collect()] == ["x"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (k INTEGER, v TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"v{i}") for i in range(100)])
        con.execute("CREATE TABLE none (k INTEGER)")
    assert sorted(tuple(r) for r in stores.sqlite_table(spark, path, "t", "k long, v string", 3).collect()) == [(i, f"v{i}") for i in range(100)]
    assert stores.sqlite_table(spark, path, "none", "k long").count() == 0


def test_chunk_store(spark, tmp_path):
    rows = spark.createDataFrame([("f", 0, "h1", b"ab"), ("f", 1, "h2", b"c"), ("f", 2, "h1", b"ab")], "ref string, index int, hash string, data binary")
    path = str(tmp_path / "store")
    new = rows.select("hash", "data")
    assert sinks.import_chunks(new, path, spark) == 2 and sinks.import_chunks(new, path, spark) == 0
    store = spark.read.parquet(path)
    assert bytes(sinks.materialized(rows.select("ref", "index", "hash"), store).first().content) == b"abcab"
    with pytest.raises(Exception, match="missing chunk"):
        sinks.materialized(spark.createDataFrame([("f", 0, "zz")], "ref string, index int, hash string"), store).collect()


def test_rows_files_and_exports(spark, tmp_path):
    one = spark.range(2).select(F.col("id").cast("string").alias("m"))
    made = lambda: sinks.meter_rows(one, F.col("m"), F.lit("call"), F.lit(1), F.lit("n"), F.lit("t")).orderBy("model").collect()
    assert made() == made() and len({r.event_id for r in made()}) == 2
    sinks.export_csv(one, ["m"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.txt", "c.bin"):
        (tmp_path / "in" / name).write_text("same" if name != "c.bin" else "other")
    index = sinks.ingested(spark.read.format("binaryFile").load(str(tmp_path / "in")), str(tmp_path / "cas"))
    assert index.count() == 3 and sorted(r.ext for r in index.collect()) == [".bin", ".txt", ".txt"] and spark.read.parquet(str(tmp_path / "cas")).count() == 2
    logs.append(one, str(tmp_path / "log"))
    logs.append(one, str(tmp_path / "log"))
    assert logs.jsonl(spark, str(tmp_path / "log")).count() == 4
    assert logs.duplicate_keys(one.union(one.limit(1)), ["m"]).count() == 1


def test_maps_intake_and_logs(spark, tmp_path):
    (tmp_path / "hosts.tsv").write_text("# territory\nwork a.example b.example ns\n\n")
    assert tuple(sinks.host_map(spark, str(tmp_path / "hosts.tsv")).first()) == ("work", "a.example", "b.example", "ns")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "x.meta.json").write_text('{"k": 1}')
    assert sinks.intake_scan(spark, str(tmp_path / "deep")).count() == 1
    (tmp_path / "array.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "object.json").write_text('{"a": 3}')
    got = [logs.whole_json(spark, str(tmp_path / f)).select(F.variant_get("v", "$.a", "int")).collect() for f in ("array.json", "object.json")]
    assert [[r[0] for r in g] for g in got] == [[1, 2], [3]]
    (tmp_path / "q.jsonl").write_text('{"task_id": "t", "state": "pending"}\nbad\n')
    assert [(r.task_id, r.state, r.worker_id) for r in logs.queue_log(spark, str(tmp_path / "q.jsonl")).collect()] == [("t", "pending", None)]
    (tmp_path / "c.jsonl").write_text('{"call_id": "1", "from": "a", "to": "b"}\n')
    (tmp_path / "s.jsonl").write_text('{"sms_id": "2", "from": "a", "to": "b", "body": "x"}\n')
    assert sorted((r.event_type, r.id, r.body) for r in logs.tel_log(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "s.jsonl")).collect()) == [("call", "1", None), ("sms", "2", "x")]
