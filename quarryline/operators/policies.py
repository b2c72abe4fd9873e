"""Fixed values of state continuity: chart families, residual bands and the policies of transitions."""

from __future__ import annotations

from dataclasses import dataclass

#: The chart families.
CHARTS = [
    "generic", "text_proof", "geo_runtime", "memory", "model_block", "liquidity_topology", "collateral_graph", "oracle_round",
    "bridge_packet", "execution_batch", "availability_root", "trust_topology", "governance_state", "identity_claim", "media_pipeline", "workflow_state",
]

#: Largest residual that is stable, boundary, novel; by chart, "default" for the others.
BANDS = {
    "default": (0.45, 0.8, 1.1),
    "text_proof": (0.4, 0.75, 1.05),
    "geo_runtime": (0.55, 0.9, 1.2),
    "memory": (0.5, 0.85, 1.15),
    "model_block": (0.35, 0.7, 1.0),
    "generic": (0.45, 0.8, 1.1),
}

#: Squared distance of cells within one neighbourhood, and a residual's rise that is drift.
NEIGHBORHOOD, DRIFT = 4.05, 0.2

#: What a kind of violation adds to the risk.
RISK = {"failed_invariant": 0.35, "missing_witness": 0.25, "residual_delta_exceeded": 0.2, "boundary_crossing_disallowed": 0.15, "chart_transition_disallowed": 0.15, "missing_invariant": 0.1}

_C, _W, _R, _P, _N = "commitment_bound", "witness_bound", "residual_bounded", "prior_commitment_present", "neighborhood_preserved"
_NEXT, _BOTH = ["next_state_witness"], ["next_state_witness", "prior_state_witness"]
#: What a first state can't have.
LATER_ONLY = [_P, _N, "prior_state_witness"]


@dataclass(frozen=True)
class Policy:
    id: str
    max_delta: float
    crossing: bool
    required: list[str]
    failing: list[str]
    witnesses: list[str]
    #: Charts that may follow a chart; a chart without an entry may go anywhere.
    moves: dict[str, list[str]]


#: The policies.
POLICIES = [
    Policy("default", 1.1, True, [_C, _W, _R], [_C, _W, _P], _NEXT, {c: CHARTS for c in CHARTS}),
    Policy("strict", 0.9, False, [_C, _W, _R, _N], [_C, _W, _R, _N, _P], _BOTH, {c: [c] for c in CHARTS}),
    Policy("handoff", 1.2, True, [_C, _W, _R, _P], [_C, _W, _P], _BOTH, {
        "generic": ["generic", "geo_runtime", "memory"],
        "geo_runtime": ["geo_runtime", "memory", "generic"],
        "memory": ["memory", "geo_runtime", "generic"],
        "text_proof": ["text_proof", "generic"],
        "model_block": ["model_block", "generic", "memory"],
        "bridge_packet": ["bridge_packet", "geo_runtime", "execution_batch", "trust_topology"],
        "execution_batch": ["execution_batch", "bridge_packet", "availability_root", "generic"],
        "availability_root": ["availability_root", "execution_batch", "generic"],
        "trust_topology": ["trust_topology", "bridge_packet", "identity_claim", "generic"],
        "identity_claim": ["identity_claim", "trust_topology", "generic"],
    }),
    Policy("finality", 0.55, False, [_C, _W, _P, _N], [_C, _W, _P, _N], _BOTH, {
        "execution_batch": ["execution_batch"],
        "availability_root": ["availability_root"],
        "generic": ["generic", "execution_batch", "availability_root"],
    }),
    Policy("settlement", 0.7, False, [_C, _W, _P], [_C, _W, _P], _BOTH, {
        "liquidity_topology": ["liquidity_topology", "collateral_graph"],
        "collateral_graph": ["collateral_graph", "liquidity_topology"],
        "generic": ["generic", "liquidity_topology", "collateral_graph"],
    }),
    Policy("liquidity", 1.0, True, [_C, _W, _R], [_C, _W], _NEXT, {
        "liquidity_topology": ["liquidity_topology", "collateral_graph", "generic"],
        "collateral_graph": ["collateral_graph", "liquidity_topology", "generic"],
        "generic": ["generic", "liquidity_topology", "collateral_graph"],
    }),
    Policy("collateral", 0.85, False, [_C, _W, _P], [_C, _W, _P], _BOTH, {"collateral_graph": ["collateral_graph"], "generic": ["generic", "collateral_graph"]}),
    Policy("oracle", 0.95, True, [_C, _W, _P], [_C, _W, _P], _BOTH, {"oracle_round": ["oracle_round", "generic"], "generic": ["generic", "oracle_round"]}),
    Policy("availability", 0.9, False, [_C, _W, _R], [_C, _W, _R], _NEXT, {"availability_root": ["availability_root"], "generic": ["generic", "availability_root"]}),
    Policy("privacy", 1.05, True, [_C, _W], [_C, _W], _NEXT, {
        "identity_claim": ["identity_claim", "trust_topology", "generic"],
        "trust_topology": ["trust_topology", "identity_claim", "generic"],
        "generic": ["generic", "identity_claim", "trust_topology"],
    }),
    Policy("restaking", 0.75, False, [_C, _W, _P, _N], [_C, _W, _P, _N], _BOTH, {
        "trust_topology": ["trust_topology", "collateral_graph"],
        "collateral_graph": ["collateral_graph", "trust_topology"],
        "generic": ["generic", "trust_topology", "collateral_graph"],
    }),
    Policy("execution_pipeline", 0.82, True, [_C, _W, _R, _P], [_C, _W, _P], _BOTH, {
        "execution_batch": ["execution_batch", "bridge_packet", "availability_root", "generic"],
        "bridge_packet": ["bridge_packet", "execution_batch", "generic"],
        "availability_root": ["availability_root", "execution_batch", "generic"],
        "workflow_state": ["workflow_state", "execution_batch", "generic"],
        "generic": ["generic", "execution_batch", "bridge_packet", "availability_root", "workflow_state"],
    }),
]


def policy(given: str | dict | None = None) -> Policy:
    """A policy by name (an unknown one is the default), or the default with some fields replaced."""
    known = {p.id: p for p in POLICIES}
    if not isinstance(given, dict):
        return known.get(given or "default", known["default"])
    base = known["default"]
    return Policy(
        given.get("id", base.id), float(given.get("max_residual_delta", base.max_delta)), bool(given.get("allow_boundary_crossing", base.crossing)),
        list(given.get("require_invariants", base.required)), list(given.get("fail_on_invariant", base.failing)),
        list(given.get("required_witnesses", base.witnesses)), dict(given.get("chart_transition_map", base.moves)),
    )
