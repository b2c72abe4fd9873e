"""Charts: states as points in [-2, 2] to the eighth, before they are snapped to the lattice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that tell a chart, looked for in this order; without any the chart is generic.
MARKS = [
    ("model_block", ["eta_L", "eta_R", "spectral_gap", "effective_rank"]),
    ("geo_runtime", ["lat", "lon", "latency_ms", "region_index"]),
    ("memory", ["task_count", "feature_count", "slot_count", "sae_dim"]),
    ("text_proof", ["text", "content", "proof_hash", "text_hash"]),
]

#: The dimensions of the charts that have fields: field, transform, least, greatest, factor and shift of the scaled value.
DIMENSIONS = {
    "geo_runtime": [
        ("lat", "", -90, 90, 1, 0), ("lon", "", -180, 180, 1, 0), ("latency_ms", "log1p", 0, 2000, 2, -2), ("region_index", "", 0, 255, 1, 0),
        ("bandwidth_mbps", "log1p", 0, 10000, 2, -2), ("relay_count", "", 0, 16, 1, 0), ("cache_hit_rate", "", 0, 1, 1, 0), ("error_rate", "", 0, 1, -2, 0),
    ],
    "memory": [
        ("task_count", "", 0, 1000, 1, 0), ("feature_count", "", 0, 4096, 1, 0), ("slot_count", "", 0, 256, 1, 0), ("sae_dim", "log2", 0, 16, 2, -2),
        ("routing_layers", "", 0, 32, 1, 0), ("cache_slots", "", 0, 512, 1, 0), ("revision", "mod256", 0, 255, 1, 0), ("proof_hash", "hash", 0, 0, 1, 0),
    ],
    "model_block": [
        ("eta_L", "", 0, 1, 1, 0), ("eta_R", "", 0, 1, 1, 0), ("spectral_gap", "", 0, 10, 1, 0), ("effective_rank", "log2", 0, 12, 2, -2),
        ("energy_closure", "", 0, 1, 1, 0), ("subspace_compatibility", "", 0, 1, 1, 0), ("layer_index", "", 0, 256, 1, 0), ("block_type", "digest", 0, 0, 1, 0),
    ],
}


def from_hash(hex_digest: Column, place: int) -> Column:
    """The ``place``-th 32-bit word of a digest, from 0 to its largest, as a number in [-2, 2]."""
    word = F.conv(F.substring(hex_digest, 8 * place + 1, 8), 16, 10).cast("double")
    return word / 4294967295.0 * 4 - 2


def scaled(x: Column, least: float, greatest: float) -> Column:
    return (F.least(F.greatest(x, F.lit(float(least))), F.lit(float(greatest))) - least) / (greatest - least) * 4 - 2


def by_hash(text: Column) -> Column:
    """All coordinates from the text's own hash: equal texts, and only they, are at one place."""
    digest = F.sha2(text, 256)
    return F.array(*[from_hash(digest, i) for i in range(8)])


def by_fields(chart: str, fields: dict[str, Column], serialized: Column) -> Column:
    """Coordinates from fields; one that is missing or null comes from the hash of the serialised state."""
    digest = F.sha2(serialized, 256)
    out = []
    for place, (name, kind, least, greatest, factor, shift) in enumerate(DIMENSIONS[chart]):
        fallback = from_hash(digest, place)
        if name not in fields:
            out.append(fallback)
            continue
        x = fields[name]
        if kind == "hash":
            bare = F.regexp_replace(x, "^sha256:", "")
            out.append(F.when(F.length(bare) >= 8, from_hash(bare, 0)).otherwise(fallback))
            continue
        if kind == "digest":
            out.append(F.when(x != "", from_hash(F.sha2(x, 256), 0)).otherwise(fallback))
            continue
        x = x.cast("double")
        value = {"": lambda: scaled(x, least, greatest), "mod256": lambda: scaled(x % 256, least, greatest), "log2": lambda: scaled(F.log2(F.greatest(x, F.lit(1.0))), least, greatest)}
        value["log1p"] = lambda: (F.least(F.greatest(F.log1p(x), F.lit(0.0)), F.log1p(F.lit(float(greatest)))) / F.log1p(F.lit(float(greatest)))) * 4 - 2
        out.append(F.when(x.isNotNull(), value[kind]() * factor + shift).otherwise(fallback))
    return F.array(*out)


def detected(keys: Column) -> Column:
    """The chart of a state by the names of its fields; null (not an object) is a text."""
    out = F.when(keys.isNull(), "text_proof")
    for chart, marks in MARKS:
        out = out.when(F.arrays_overlap(keys, F.array(*map(F.lit, marks))), chart)
    return out.otherwise("generic")


def witness(cell_key: Column, serialized: Column) -> Column:
    """Binds a cell to the state's content."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(cell_key, F.lit(":"), F.sha2(serialized, 256)), 256))
