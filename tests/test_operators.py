import json
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import jsonish, tensors, text
from quarryline.operators import chunks, continuity, lineage, planning, vectors
from quarryline.plans import catalog
from quarryline.sources import binary, logs
from quarryline.functions import formulas
from quarryline.operators import policies
from quarryline.streaming import events as streams

M = 1 << 20


@pytest.mark.parametrize("data,lengths", [(b"\xaa" * M + b"\xbb" * M, [M, M]), (b"A" * M + b"B" * M + b"C" * M, [M, M, M]), (b"A" * M + b"x" * 20 + b"B" * M + b"C" * M, [M, M, M, 20]), (b"", [0])])
def test_chunker_on_constant_data(data, lengths):
    ends = chunks.cut_points(data)
    assert [b - a for a, b in zip([0, *ends], ends)] == lengths


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=0, max_size=5000))
def test_chunks_cover_the_data(data):
    ends = chunks.cut_points(data, 64, 256, 1024, 6)
    assert ends[-1] == len(data) and ends == sorted(set(ends))


def test_skipping_ahead_changes_no_cut():
    data = np.random.default_rng(0).integers(0, 256, 20000, dtype=np.uint8).tobytes()

    def plain(least, target, mask):
        out, start, rolling, table = [], 0, 0, chunks.gear_table()
        for i, b in enumerate(data):
            rolling = ((rolling << 1) + table[b]) & 0xFFFFFFFF
            size = i + 1 - start
            if size >= least and (not rolling & mask or size >= target):
                out.append(i + 1)
                start, rolling = i + 1, 0
        return out if start == len(data) else [*out, len(data)]

    assert chunks.cut_points(data, 256, 1024, 4096, 8) == plain(256, 1024, 255)


def test_drift(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "hash string, size long")
    b = spark.createDataFrame([("x", 1), ("z", 1)], "hash string, size long")
    r = chunks.pair_drift(a, b).first()
    assert (r.shared, r.removed, r.new, r.drift) == (1, 1, 1, 0.666667)
    none = a.limit(0)
    assert chunks.pair_drift(none, none).first().jaccard == 1.0


def test_tensor_file(spark, tmp_path):
    x = np.arange(64, dtype="<f4")
    header = json.dumps({"layer0.q_proj": {"dtype": "F32", "shape": [8, 8], "data_offsets": [0, 256]}}).encode()
    path = tmp_path / "t.bin"
    path.write_bytes(struct.pack("<Q", len(header)) + header + x.tobytes())
    rows = binary.tensors(spark, str(path)).collect()
    assert [(r.name, r.elements, r.kind) for r in rows] == [("layer0.q_proj", 64, "self_attention")]
    assert binary.sampled(spark, str(path)).first()["values"] == x.tolist()
    assert binary.strided(np.arange(10.0), 4, 2, "x").tolist() == [0, 2, 4, 6]
    assert binary.strided(np.array([1, np.nan, np.inf, 4.0]), 9, 2, "x").tolist() == [1, 4]
    with pytest.raises(ValueError):
        binary.strided(np.arange(10.0), 4, 5, "x")
    assert binary.decoded("U8", b"\xff\x7f").tolist() == [-1 / 127, 1.0] and len(binary.decoded("I64", b"12345678")) == 0
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "f").write_bytes(np.arange(300, dtype="<f4").tobytes() + b"x")
    assert len(binary.raw_sampled(spark, str(tmp_path / "raw"), 150).first()["values"]) == 150
    kinds = {"model.cross_attn.q": "cross_attention", "blocks.0.fc1": "ffn", "wte": "embedding", "ln_f": "norm", "kv_cache.0": "kv_cache", "conv1": "layer"}
    made = spark.createDataFrame([(k,) for k in kinds], "n string").select("n", binary.kind_of(F.col("n")).alias("k")).collect()
    assert {k: binary.tensor_kind(k) for k in kinds} == kinds == {r.n: r.k for r in made}
    spark.dataSource.register(binary.TensorFiles)
    assert spark.read.format("tensorfile").option("paths", str(path)).load().count() == 1
    with pytest.raises(ValueError):
        binary.tensor_rows("p", struct.pack("<Q", 999) + b"{}")


def test_packed_forms(spark, tmp_path):
    nodes, edges = [("ab" * 32, "audit-entry", "put"), ("cd" * 32, "event", "get")], [(0, 1), (1, 1), (300, 2)]
    data = binary.proof_packed(nodes, edges, {"a": 1})
    assert binary.proof_unpacked(data) == (nodes, edges, {"a": 1})
    (tmp_path / "p").write_bytes(data)
    assert binary.proof_nodes(spark, str(tmp_path / "p")).count() == 2 and binary.proof_edges(spark, str(tmp_path / "p")).count() == 3
    files = {"a": [b"xx", b"yyy"], "b": [b"yyy", b"z"]}
    pack = binary.pack_packed(files)
    assert binary.pack_files(pack) == {n: b"".join(p) for n, p in files.items()}
    (tmp_path / "k").write_bytes(pack)
    assert [(r.size, r.refs) for r in binary.pack_chunks(spark, str(tmp_path / "k")).orderBy("offset").collect()] == [(1, 1), (2, 1), (3, 2)]
    assert [r.first_chunk for r in binary.pack_regions(spark, str(tmp_path / "k")).collect()] == [0, 2]
    with pytest.raises(ValueError):
        binary.manifest_unpacked(b"x" * 40)


def test_logs(spark, tmp_path):
    (tmp_path / "m1.jsonl").write_text('{"recorded_at": "2024-01-02T00:00:00Z", "event": "call", "quantity": 2}\nnot json\n{"recorded_at": "bad", "event": "a:b", "quantity": "12"}\n{"recorded_at": "2023-01-01T00:00:00Z", "event": "old"}\n')
    rows = logs.meter_log(spark, str(tmp_path), "2024-01-01").collect()
    assert sorted((r.model, r.event, r.quantity) for r in rows) == [("m1", "a:b", 12.0), ("m1", "call", 2.0)]
    assert logs.audit_log(spark, str(tmp_path)).count() == 3
    assert logs.jsonl(spark, str(tmp_path)).count() == 3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=8, max_size=8))
def test_lattice(point):
    cell, squared = vectors.snap(np.array([point]))
    again, zero = vectors.snap(cell)
    assert (again == cell).all() and zero[0] == 0 and squared[0] <= 1 + 1e-9
    assert cell.sum() % 2 == 0


def test_embedding_matches_python(spark):
    import hashlib

    base = hashlib.sha256(b"abc").digest()
    raw = [round((lambda s: (s[0] * 256 + s[1]) / 65535 * 2 - 1)(hashlib.sha256(base + bytes([i])).digest()), 6) for i in range(64)]
    norm = sum(x * x for x in raw) ** 0.5
    got = spark.range(1).select(vectors.embedded(F.lit("abc")).alias("v")).first().v
    assert got == pytest.approx([round(x / norm, 6) for x in raw], abs=1e-6)


@pytest.mark.parametrize("levels", [10, 2])
def test_merkle(spark, monkeypatch, levels):
    import hashlib

    monkeypatch.setattr(lineage, "LEVELS", levels)
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows, want = [], {}
    for n in (1, 2, 4, 5, 16, 17, 33, 65):
        leaves = [h(f"{n}-{i}") for i in range(n)]
        rows += [(n, i, x) for i, x in enumerate(leaves)]
        while len(leaves) > 1:
            leaves = [h(leaves[i] + leaves[min(i + 1, len(leaves) - 1)]) for i in range(0, len(leaves), 2)]
        want[n] = leaves[0]
    df = spark.createDataFrame(rows, "k int, i int, leaf string")
    assert {r.k: r.root for r in lineage.merkle_root(df, "k", "i", "leaf").collect()} == want


def test_json():
    assert jsonish.canonical({"b": 1.0, "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":1}'
    assert jsonish.differences({"a": 1, "b": 2}, {"b": 3, "c": 4}) == [("$.a", "remove", "1", None), ("$.b", "replace", "2", "3"), ("$.c", "add", None, "4")]


def test_text(spark):
    row = spark.range(1).select(text.slug(F.lit("--A b!!C--")).alias("s"), text.transcript_lines(F.lit("a  b\n\na  b\num, yes [inaudible]\n")).alias("t"), text.sentences(F.lit("One. Two!  Three")).alias("n")).first()
    assert row.s == "-a-b-c-".strip("-") and row.t == ["a b", ", yes \u2026"] and row.n == ["One.", "Two!", "Three"]
    assert text.reflow("aa bb cc".split(), 5) == ["aa bb", "cc"]


def test_plan_order():
    assert planning.planned({"pull": [], "serve": ["pull"], "route": ["serve"]}) == (["pull", "serve", "route"], [])
    order, errors = planning.planned({"a": ["b"], "b": ["a", "zz"]})
    assert not order and len(errors) == 2


def test_commutator_of_itself_is_zero():
    a = np.arange(16.0).reshape(4, 4)
    assert tensors.commutators(a[None], a[None])[0] == 0


def test_gauge_keeps_length():
    x, p = np.array([1.0, 2.0, 3.0]), np.array([1.0, 0.0, 0.0])
    assert np.linalg.norm(tensors.gauge_fixed(x, p)) == pytest.approx(np.linalg.norm(x))


def test_transition_classes(spark):
    z, far = [0.0] * 8, [2.0, 1.0] + [0.0] * 6
    rows = [
        ("k", 1, "memory", 0.1, z, "c", "w", "event"), ("k", 2, "memory", 0.2, z, "c", "w", "event"), ("k", 3, "text_proof", 0.2, z, "c", "w", "event"), ("k", 4, "text_proof", 0.6, z, "c", "w", "event"),
        ("k", 5, "text_proof", 0.1, far, "c", "w", "event"), ("k", 6, "text_proof", 0.1, z, "c", "w", "space.state"), ("k", 7, "text_proof", 1.2, None, "c", "w", "event"), ("k", 8, "text_proof", 0.1, None, "c", None, "event"),
    ]
    s = spark.createDataFrame(rows, "k string, o int, chart string, residual double, cell array<double>, commitment string, witness string, type string")
    moves = continuity.transitions(s, ["k"], "o")
    want = ["INITIALIZED", "PASS", "BOUNDARY_CROSSING", "PASS_WITH_DRIFT", "CONTINUITY_FAIL", "PASS", "CONTINUITY_FAIL", "CONTINUITY_FAIL"]
    assert [r["class"] for r in moves.orderBy("o").collect()] == want
    strict = continuity.judged(moves, [policies.policy("strict")]).withColumn("t", continuity.triggered()).orderBy("o").collect()
    assert [r["verdict"] for r in strict][:3] == ["INITIALIZED", "PASS", "CONTINUITY_FAIL"] and strict[2]["t"] == ["boundary_crossing_disallowed", "chart_transition_disallowed"]
    assert strict[4]["t"] == ["neighborhood_preserved"] and strict[7]["t"] == ["witness_bound", "missing_witness:next_state_witness"] and strict[7]["risk"] == 0.6


def test_streams(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").limit(200)
    e.write.parquet(str(tmp_path / "in"))
    stream = streams.tail(spark, str(tmp_path / "in"), e.schema, "ts")
    got = streams.drained(streams.windowed(stream, "ts", "event_type", "value", "6 hours"), "tumbled", "complete")
    assert got.agg(F.sum("n")).first()[0] == 200
    (tmp_path / "obs").mkdir()
    spark.createDataFrame([("p", 3, "y"), ("p", 1, "x"), ("p", 2, "x"), ("q", 1, "z")], "path string, ord long, hash string").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "obs"))
    obs = spark.readStream.schema("path string, ord long, hash string").parquet(str(tmp_path / "obs"))
    states = sorted((r.path, r.ord, r.state) for r in streams.drained(streams.watched(obs, "path", "hash", "ord"), "watched", "append").collect())
    assert states == [("p", 1, "FIRST_OBSERVATION"), ("p", 2, "UNCHANGED"), ("p", 3, "CHANGED"), ("q", 1, "FIRST_OBSERVATION")]


def test_blended_search_answers_every_query(spark, small, monkeypatch):
    rows = catalog.vec_topk_blended(spark, small).collect()
    p = catalog._points(spark, small)
    store = vectors.snapped(p, "vec_id", "point").join(p.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), "key").cache()
    queries = store.filter("key % 50 = 0").collect()
    want = [(q.key, r.key, r.cell_key, r.score) for q in queries for r in vectors.blended(store, [float(x) for x in q.vector], q.cell, 10).collect()]
    assert len({q.key for q in queries}) == 10
    assert sorted((r.query, r.key, r.cell_key, r.score) for r in rows) == sorted(want)
    odd = store.filter("key < 120").unionByName(spark.createDataFrame([(900, None, None, None, [1.0, 2.0]), (901, None, None, None, [0.0] * 64)], store.schema))
    monkeypatch.setattr(vectors, "ROWS", 50)
    monkeypatch.setattr(vectors, "QUERIES", 2)
    some = [q for q in queries if q.key < 120]
    got = vectors.blended_each(odd, odd.filter("key % 50 = 0 AND key < 120"), 200).collect()
    want = [(q.key, r.key, r.score) for q in some for r in vectors.blended(odd, [float(x) for x in q.vector], q.cell, 200).collect()]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_to_fixed_rounds_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [1.005, 2.675, 0.125, 1.0000005, -1.005, -0.125, 0.0, 1e-9, 123456.785, 8.345, 1.45, 0.285, 1e17] + np.random.default_rng(1).normal(0, 100, 400).round(3).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 2, 4, 8):
        got = [r.x for r in df.select(formulas.to_fixed(F.col("v"), places).alias("x")).collect()]
        assert got == [float(Decimal(v).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) for v in values]


def test_policies_merge_over_the_default():
    p = policies.policy({"id": "own", "max_residual_delta": 0.1, "required_witnesses": []})
    d = policies.policy("nothing like it")
    assert (p.id, p.max_delta, p.witnesses, p.required) == ("own", 0.1, [], d.required) and d.id == "default" and len(policies.POLICIES) == 12


def test_logs_promote_continuity_fields(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00Z", "metadata": {"continuity_policy": "strict", "chart_id": "x"}, "residual_delta": 1, "proof_hash": "h"}\n')
    row = logs.audit_log(spark, str(tmp_path)).first()
    assert row.continuity_policy == "strict" and row.residual_delta == "1" and "chart_id" not in logs.CONTINUITY_FIELDS


def test_clause_scanner():
    from quarryline.plans.predicate import scanned

    cases = {"a=b": ("a", "=", "b"), "a =~ b%": ("a", "=~", " b%"), "a~=b": ("a", "~=", "b"), "a:b:c": ("a", "=", "b"), "a like '%x%'": ("a", "like", "%x%"), "a like x y": ("a", "like", "x y"), "a>5": None, "x": None, "a>=5": ("a", ">=", "5"), "a!=b=c": ("a", "!=", "b=c")}
    assert {k: scanned(k) for k in cases} == cases


def test_query_keeps_empty_json_strings(spark):
    from quarryline.plans.predicate import query

    df = spark.createDataFrame([(1, '{"a": ""}'), (2, "{}")], "ord long, j string")
    assert [r["j.a"] for r in query(df, "ord>=1", ["ord", "j.a"], None, json_columns=("j",)).orderBy("ord").collect()] == ["", None]
