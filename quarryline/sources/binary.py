"""Binary formats: tensor files, packs, and the columnar proof and manifest forms."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Element sizes by type name.
WIDTHS = {"F16": 2, "BF16": 2, "F32": 4, "F64": 8, "I8": 1, "U8": 1, "I16": 2, "U16": 2, "I32": 4, "U32": 4, "I64": 8, "U64": 8, "BOOL": 1}

TENSORS = "path string, name string, dtype string, shape array<long>, elements long, start long, end long, kind string"


#: Classes of tensors and the marks in a name, the first that occurs; attention is crossed where a second mark occurs.
KIND_MARKS = [
    ("self_attention", ["q_proj", "k_proj", "v_proj", "o_proj", "attn", "self_attn", "query", "key", "value", "attention"]),
    ("ffn", ["mlp", "ffn", "fc1", "fc2", "gate_proj", "up_proj", "down_proj", "dense"]),
    ("embedding", ["embed", "_emb", "emb_", "tok_emb", "wte", "wpe", "position_embedding", "lm_head"]),
    ("norm", ["norm", "ln_", "layernorm", "rmsnorm"]),
    ("kv_cache", ["kv_cache", "kvcache", "past_key", "past_value"]),
]
CROSS_MARKS = ["cross", "enc_dec"]


def tensor_kind(name: str) -> str:
    """The first class of which a mark occurs in the name; ``layer`` otherwise."""
    n = name.lower()
    kind = next((k for k, marks in KIND_MARKS if any(m in n for m in marks)), "layer")
    return "cross_attention" if kind == "self_attention" and any(m in n for m in CROSS_MARKS) else kind


def kind_of(name: Column) -> Column:
    """``tensor_kind`` of a column."""
    n = F.lower(name)
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(n, m))
    out = F.when(has(KIND_MARKS[0][1]), F.when(has(CROSS_MARKS), "cross_attention").otherwise("self_attention"))
    for kind, marks in KIND_MARKS[1:]:
        out = out.when(has(marks), kind)
    return out.otherwise("layer")


def tensor_rows(path: str, data: bytes) -> list[tuple]:
    """Tensors of a file: u64 header length, JSON header, then values; ranges must lie inside."""
    (size,) = struct.unpack_from("<Q", data)
    if 8 + size > len(data):
        raise ValueError(f"header of {path} is longer than the file")
    out = []
    for name, t in json.loads(data[8 : 8 + size]).items():
        if name == "__metadata__":
            continue
        a, b = t["data_offsets"]
        n = int(np.prod(t["shape"], dtype=np.int64))
        if not 0 <= a <= b <= len(data) - 8 - size or n * WIDTHS[t["dtype"]] != b - a:
            raise ValueError(f"tensor {name} of {path} has a wrong range")
        out.append((path, name, t["dtype"], t["shape"], n, 8 + size + a, 8 + size + b, tensor_kind(name)))
    return out


#: Values that a sample takes, and the least it must hold; of a tensor and of a raw file.
SAMPLES, LEAST_SAMPLES, RAW_SAMPLES, RAW_LEAST = 4096, 64, 8192, 128


def decoded(dtype: str, raw: bytes) -> np.ndarray:
    """Values as doubles; what isn't F16, BF16 or F32 is read as signed integers of its width, scaled by their largest; widths above 4 give nothing."""
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4").astype(float)
    if dtype in ("F16", "F32"):
        return np.frombuffer(raw, {"F16": "<f2", "F32": "<f4"}[dtype]).astype(float)
    kind = {1: "i1", 2: "<i2", 4: "<i4"}.get(WIDTHS[dtype])
    return np.frombuffer(raw, kind).astype(float) / np.iinfo(kind).max if kind else np.zeros(0)


def strided(values: np.ndarray, most: int, least: int, what: str) -> np.ndarray:
    """Finite values at a stride of floor(n / most), at most ``most`` places; too few fail."""
    taken = values[:: max(1, len(values) // most)]
    finite = taken[np.isfinite(taken)][:most]
    if len(finite) < least:
        raise ValueError(f"{what} has {len(finite)} numbers; {least} are needed")
    return finite


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """Tensor headers of all files under ``path``; files are read by Spark, so any store will do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in tensor_rows(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "elements", "start", "end", "kind"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TENSORS)


def sampled(spark: SparkSession, path: str, most: int = SAMPLES) -> DataFrame:
    """Every tensor's finite values at a stride that takes at most ``most`` of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                data = bytes(c)
                for _, name, dtype, _, n, a, b, _ in tensor_rows(p, data):
                    rows.append((p, name, strided(decoded(dtype, data[a:b]), most, LEAST_SAMPLES, f"tensor {name} of {p}").tolist()))
            yield pd.DataFrame(rows, columns=["path", "name", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, values array<double>")


def raw_sampled(spark: SparkSession, path: str, most: int = RAW_SAMPLES) -> DataFrame:
    """Files of plain 32-bit floats, sampled as tensors are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                data = bytes(c)
                rows.append((p, strided(np.frombuffer(data[: len(data) // 4 * 4], "<f4").astype(float), most, RAW_LEAST, p).tolist()))
            yield pd.DataFrame(rows, columns=["path", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, values array<double>")


class TensorFiles(DataSource):
    """``spark.read.format("tensorfile").option("paths", "a,b")``: one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "tensorfile"

    def schema(self) -> str:
        return TENSORS

    def reader(self, schema) -> DataSourceReader:
        return _TensorReader(self.options)


class _TensorReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split(",") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            yield from tensor_rows(partition.value, f.read())


def range_of(content: str, start: int, end: int):
    """Bytes start to end (exclusive) of a binary column."""
    return F.substring(content, start + 1, end - start)


# --- binary manifests, packs and proofs: fixed layouts, little-endian ------------------------------

#: The first bytes of each format and the sizes of its records.
MANIFEST_MAGIC, PACK_MAGIC, PROOF_MAGIC = b"AKMBIN01", b"AKPACKV2", b"AKPRF01\x00"
_CHUNK = np.dtype([("hash", "V32"), ("offset", "<u8"), ("size", "<u4"), ("refs", "<u4")])
_REGION = np.dtype([("name", "<u4"), ("first", "<u4"), ("count", "<u4"), ("size", "<u8")])
_NODE = np.dtype([("hash", "<u4"), ("type", "<u4"), ("label", "<u4")])
_PROOF_HEAD = struct.Struct("<8sHHIIIII")


def manifest_packed(chunk_rows: list[tuple[str, int, int, int]], regions: list[tuple[str, int, int, int]]) -> bytes:
    """Chunks (hex hash, offset, size, refs) and regions (name, first chunk, chunks, size) as one binary manifest."""
    places: dict[str, int] = {}
    names = bytearray()
    for name, *_ in regions:
        if name not in places:
            places[name] = len(names)
            names += name.encode() + b"\0"
    one = np.array([(bytes.fromhex(h), o, s, r) for h, o, s, r in chunk_rows], _CHUNK)
    two = np.array([(places[n], f, c, s) for n, f, c, s in regions], _REGION)
    return MANIFEST_MAGIC + struct.pack("<4I", len(regions), len(chunk_rows), len(names), 1) + one.tobytes() + two.tobytes() + bytes(names)


def manifest_unpacked(data: bytes) -> tuple[list[tuple[str, int, int, int]], list[tuple[str, int, int, int]]]:
    if data[:8] != MANIFEST_MAGIC:
        raise ValueError("not a binary manifest")
    n_regions, n_chunks, n_names, _ = struct.unpack_from("<4I", data, 8)
    one = np.frombuffer(data, _CHUNK, n_chunks, 24)
    at = 24 + one.nbytes
    two = np.frombuffer(data, _REGION, n_regions, at)
    names = data[at + two.nbytes : at + two.nbytes + n_names]
    named = lambda start: names[start : names.index(b"\0", start)].decode()
    return (
        [(bytes(c["hash"]).hex(), int(c["offset"]), int(c["size"]), int(c["refs"])) for c in one],
        [(named(int(r["name"])), int(r["first"]), int(r["count"]), int(r["size"])) for r in two],
    )


def pack_index(data: bytes) -> tuple[dict, list[tuple[str, int, int, int]], list[tuple[str, int, int, int]], int]:
    """A pack's metadata, chunks, regions and where its payload starts."""
    if data[:8] != PACK_MAGIC:
        raise ValueError("not a pack")
    n_meta, n_manifest = struct.unpack_from("<2Q", data, 8)
    start = 24 + n_meta
    return (json.loads(data[24:start]), *manifest_unpacked(data[start : start + n_manifest]), start + n_manifest)


def pack_packed(files: dict[str, list[bytes]]) -> bytes:
    """A pack of files given as chunks: equal chunks are stored once, smallest first."""
    import hashlib

    uses: dict[str, int] = {}
    body: dict[str, bytes] = {}
    for parts in files.values():
        for p in parts:
            h = hashlib.sha256(p).hexdigest()
            uses[h] = uses.get(h, 0) + 1
            body[h] = p
    order = sorted(body, key=lambda h: (len(body[h]), h))
    offsets = dict(zip(order, np.concatenate([[0], np.cumsum([len(body[h]) for h in order])]).tolist()))
    regions, first = [], 0
    for name, parts in files.items():
        regions.append((name, first, len(parts), sum(map(len, parts))))
        first += len(parts)
    refs = [[order.index(hashlib.sha256(p).hexdigest()) for p in parts] for parts in files.values()]
    meta = json.dumps({"files": [{"name": n, "chunk_refs": r} for n, r in zip(files, refs)]}).encode()
    manifest = manifest_packed([(h, offsets[h], len(body[h]), uses[h]) for h in order], regions)
    return PACK_MAGIC + struct.pack("<2Q", len(meta), len(manifest)) + meta + manifest + b"".join(body[h] for h in order)


def pack_files(data: bytes) -> dict[str, bytes]:
    """The files of a pack, put together from its chunks."""
    meta, chunk_rows, _, start = pack_index(data)
    part = lambda i: data[start + chunk_rows[i][1] : start + chunk_rows[i][1] + chunk_rows[i][2]]
    return {f["name"]: b"".join(map(part, f["chunk_refs"])) for f in meta["files"]}


def _put(n: int) -> bytes:
    """Unsigned LEB128."""
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _get(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, at, shift = n | (b & 0x7F) << shift, at + 1, shift + 7
        if b < 0x80:
            return n, at


def proof_packed(nodes: list[tuple[str, str, str]], edges: list[tuple[int, int]], meta: dict | None = None) -> bytes:
    """Nodes (hex hash, type, label) and edges (indexes of nodes): string table, hashes, node table, varint edges, metadata."""
    strings = list(dict.fromkeys(s for _, *pair in nodes for s in pair))
    place = {s: i for i, s in enumerate(strings)}
    table = b"".join(struct.pack("<H", len(s.encode())) + s.encode() for s in strings)
    rows = np.array([(i, place[t], place[x]) for i, (_, t, x) in enumerate(nodes)], _NODE)
    more = json.dumps(meta or {}, separators=(",", ":")).encode()
    head = _PROOF_HEAD.pack(PROOF_MAGIC, 1, 0, len(strings), len(nodes), len(edges), len(nodes), len(more))
    return head + table + b"".join(bytes.fromhex(h) for h, *_ in nodes) + rows.tobytes() + b"".join(_put(a) + _put(b) for a, b in edges) + more


def proof_unpacked(data: bytes) -> tuple[list[tuple[str, str, str]], list[tuple[int, int]], dict]:
    magic, version, _, n_strings, n_hashes, n_edges, n_nodes, n_meta = _PROOF_HEAD.unpack_from(data)
    if magic != PROOF_MAGIC or version != 1:
        raise ValueError("not a packed proof")
    at, strings = _PROOF_HEAD.size, []
    for _ in range(n_strings):
        (size,) = struct.unpack_from("<H", data, at)
        strings.append(data[at + 2 : at + 2 + size].decode())
        at += 2 + size
    hashes = [data[at + 32 * i : at + 32 * i + 32].hex() for i in range(n_hashes)]
    at += 32 * n_hashes
    rows = np.frombuffer(data, _NODE, n_nodes, at)
    at += rows.nbytes
    edges = []
    for _ in range(n_edges):
        a, at = _get(data, at)
        b, at = _get(data, at)
        edges.append((a, b))
    return [(hashes[r["hash"]], strings[r["type"]], strings[r["label"]]) for r in rows], edges, json.loads(data[at : at + n_meta])


def _exploded(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in rows(bytes(c))], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def pack_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _exploded(spark, path, "path string, hash string, offset long, size long, refs long", lambda d: pack_index(d)[1])


def pack_regions(spark: SparkSession, path: str) -> DataFrame:
    return _exploded(spark, path, "path string, name string, first_chunk long, chunks long, size long", lambda d: pack_index(d)[2])


def proof_nodes(spark: SparkSession, path: str) -> DataFrame:
    return _exploded(spark, path, "path string, node long, hash string, type string, label string", lambda d: [(i, *n) for i, n in enumerate(proof_unpacked(d)[0])])


def proof_edges(spark: SparkSession, path: str) -> DataFrame:
    return _exploded(spark, path, "path string, from_node long, to_node long", lambda d: proof_unpacked(d)[1])
