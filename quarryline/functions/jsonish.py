"""Canonical JSON, its hash, and structural differences."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """Keys sorted at every depth, no blanks, whole numbers without a fraction."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return json.dumps(value, ensure_ascii=False)


def differences(old: object, new: object, path: str = "$") -> list[tuple[str, str, str | None, str | None]]:
    """(path, op, old, new) with op add, remove or replace."""
    if isinstance(old, dict) and isinstance(new, dict):
        out = []
        for k in sorted(old.keys() | new.keys()):
            at = f"{path}.{k}"
            if k not in new:
                out.append((at, "remove", canonical(old[k]), None))
            elif k not in old:
                out.append((at, "add", None, canonical(new[k])))
            else:
                out += differences(old[k], new[k], at)
        return out
    return [] if canonical(old) == canonical(new) else [(path, "replace", canonical(old), canonical(new))]


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, canonical form and its SHA-256; text that isn't JSON counts as null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [canonical(_parsed(t)) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "canonical": made, "canonical_hash": [hashlib.sha256(m.encode()).hexdigest() for m in made]})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, canonical string, canonical_hash string")


def compared(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """One row per difference of two JSON columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *d) for k, a, b in zip(pdf["key"], pdf["old"], pdf["new"]) for d in differences(_parsed(a), _parsed(b))]
            yield pd.DataFrame(rows, columns=["key", "path", "op", "old", "new"])

    return df.select(F.col(key).alias("key"), F.col(old).alias("old"), F.col(new).alias("new")).mapInPandas(run, "key long, path string, op string, old string, new string")


def found(df: DataFrame, key: str, text: str, field: str, wanted: str) -> DataFrame:
    """Every node, at any depth, whose ``field`` has the value ``wanted``, with its path."""

    def walk(node: object, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(node, dict):
            if node.get(field) == wanted:
                yield path, canonical(node)
            for k, v in node.items():
                yield from walk(v, f"{path}.{k}")
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from walk(v, f"{path}[{i}]")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *x) for k, t in zip(pdf["key"], pdf["text"]) for x in walk(_parsed(t), "$")]
            yield pd.DataFrame(rows, columns=["key", "path", "node"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, path string, node string")


def shallow_canonical(doc: object) -> str:
    """An object with its top-level keys sorted, and nothing below them."""
    return json.dumps({k: doc[k] for k in sorted(doc)} if isinstance(doc, dict) else doc, separators=(",", ":"), ensure_ascii=False)


def depth(doc: object, at: int = 0) -> int:
    """How deep a document nests; looked at no further than below ten levels."""
    if at > 10 or not isinstance(doc, (dict, list)):
        return at
    return max([at, *(depth(v, at + 1) for v in (doc if isinstance(doc, list) else doc.values()))])


def shaped(df: DataFrame, key: str, doc: str) -> DataFrame:
    """Per JSON document: its top-level keys in order (20 at most), their number, whether it is an array, its depth, and the hash of its shallow canonical form; null where it isn't JSON."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, text in zip(pdf["key"], pdf["doc"]):
                try:
                    d = json.loads(text)
                except (TypeError, ValueError):
                    rows.append((k, None, None, None, None, None))
                    continue
                names = list(d) if isinstance(d, dict) else [str(i) for i in range(len(d))] if isinstance(d, list) else []
                rows.append((k, names[:20], len(names), isinstance(d, list), depth(d), hashlib.sha256(shallow_canonical(d).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["key", "top_keys", "top_key_count", "is_array", "depth", "shallow_hash"])

    return df.select(F.col(key).alias("key"), F.col(doc).alias("doc")).mapInPandas(run, "key long, top_keys array<string>, top_key_count long, is_array boolean, depth long, shallow_hash string")
