"""Parameters of a graph build, their checks, and the rules that derive sizes from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

FINAL_PRUNES = ("none", "robust", "spine", "lune")


@dataclass(frozen=True)
class BuildParams:
    """Defaults are the library's; production() has those of large builds.

    c_min, c_max: leaf sizes. psamp: share of a node's points that lead clusters. fanout_top, fanout_second: nearest
    leaders that a point joins at depth 0 and 1 (deeper: 1). leaf_knn: neighbours found in a leaf. l_max: candidates
    kept for a source. m_bits: hyperplanes of a sketch.
    """

    m_bits: int = 12
    l_max: int = 64
    c_min: int = 256
    c_max: int = 2048
    psamp: float = 0.001
    max_leaders: int = 1000
    max_depth: int = 10
    min_shrink_ratio: float = 1.5
    fanout_top: int = 10
    fanout_second: int = 3
    leaf_knn: int = 2
    leaf_cap: int = 3500
    max_degree: int = 64
    seed: int = 42
    metric: str = "l2"
    reservoir: str = "nearest"
    final_prune: str = "none"
    start: int | None = None
    ads_epsilon: float = 1.75
    ads_group: int = 32
    spine_budget: int = 2
    spine_fraction: float = 0.8
    lune_width: float = 2.0
    lune_witnesses: int = 4
    lune_core: int = 0

    def __post_init__(self) -> None:
        rules = {
            "metric must be l2": self.metric == "l2",
            "m_bits must be in 1..16": 1 <= self.m_bits <= 16,
            "c_min must be positive and at most c_max": 0 < self.c_min <= self.c_max,
            "leaf_knn must be in 1..32": 1 <= self.leaf_knn <= 32,
            "fanouts must be in 1..32": 1 <= self.fanout_top <= 32 and 1 <= self.fanout_second <= 32,
            "max_leaders must be in 1..65536": 1 <= self.max_leaders <= 65536,
            "psamp must be finite and positive": math.isfinite(self.psamp) and self.psamp > 0,
            "l_max, max_degree, max_depth and leaf_cap must be positive": min(self.l_max, self.max_degree, self.max_depth, self.leaf_cap) > 0,
            "min_shrink_ratio must be at least 1": self.min_shrink_ratio >= 1,
            "reservoir must be nearest, bucket or ordered": self.reservoir in ("nearest", "bucket", "ordered"),
            f"final_prune must be one of {FINAL_PRUNES}": self.final_prune in FINAL_PRUNES,
            "ads_epsilon must be finite and positive": math.isfinite(self.ads_epsilon) and self.ads_epsilon > 0,
            "ads_group must be positive": self.ads_group > 0,
            "spine_budget must be at most max_degree": 0 <= self.spine_budget <= self.max_degree,
            "spine_fraction must be in 0..1": 0 <= self.spine_fraction <= 1,
            "lune_width must be finite and positive": math.isfinite(self.lune_width) and self.lune_width > 0,
            "lune_witnesses must be in 1..65535": 1 <= self.lune_witnesses <= 65535,
            "lune_core must be at most max_degree": 0 <= self.lune_core <= self.max_degree,
        }
        broken = [text for text, holds in rules.items() if not holds]
        if broken:
            raise ValueError("; ".join(broken))

    @classmethod
    def production(cls, **changes) -> BuildParams:
        return replace(cls(c_max=1280, psamp=0.0057, max_leaders=5000, fanout_top=8, ads_epsilon=1.0, ads_group=64), **changes)

    def fanout(self, depth: int) -> int:
        return (self.fanout_top, self.fanout_second, 1)[min(depth, 2)]

    def size_limit(self, total: int) -> int:
        """Leaves may be twice as large from five million points."""
        return self.c_max * (2 if total >= 5_000_000 else 1)

    def leader_share(self, size: int, depth: int) -> float:
        return leader_share(self.psamp, size, depth)

    def leaders(self, size: int, depth: int) -> int:
        return min(max(2, round(self.leader_share(size, depth) * size)), self.max_leaders, size)

    def root_leaders(self, size: int) -> int:
        """The root uses the share as it is given."""
        return min(max(1, round(self.psamp * size)), self.max_leaders, size)

    def lune_candidates(self) -> int:
        return min(max(math.ceil(self.max_degree * self.lune_width), self.max_degree), 4 * self.max_degree)


#: Factors of the leader share by size (from so many points) and by depth (beyond it), and its bounds.
SIZE_FACTORS = ((20_000_000, 0.05), (10_000_000, 0.1), (5_000_000, 0.2), (1_000_000, 0.4), (100_000, 0.7))
DEPTH_FACTORS = ((4, 0.35), (2, 0.5), (0, 0.8))
SHARE_BOUNDS = (0.00005, 0.1)


def leader_share(psamp: float, size: int, depth: int) -> float:
    by_size = next((f for n, f in SIZE_FACTORS if size >= n), 1.0)
    by_depth = next((f for d, f in DEPTH_FACTORS if depth > d), 1.0)
    return min(max(psamp * by_size * by_depth, SHARE_BOUNDS[0]), SHARE_BOUNDS[1])
