"""Default thresholds. Every operator also takes them as plain arguments."""

from __future__ import annotations

from dataclasses import dataclass


# These defaults decide which rows an operator keeps.
@dataclass(frozen=True)
class Thresholds:
    top_quantile: float = 0.90
    min_item_frequency: int = 15
    min_bundle_support: float = 0.002
    min_bundle_count: int = 20
    fdr_alpha: float = 0.05
    triple_seed_pairs: int = 300
    regression_bundles: int = 30
    regression_regions: int = 5
    min_edge_weight: int = 25
    max_graph_nodes: int = 150
    topics: int = 8
    seed: int = 42
    min_region_entities: int = 15
    min_locality_entities: int = 5
    min_region_holders: int = 5


DEFAULTS = Thresholds()

UNKNOWN = "Unknown"
