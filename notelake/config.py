"""Every tunable of retrieval, with the live defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Field weights of the lexical index.
FIELD_WEIGHTS = {"title": 10.0, "aliases": 6.0, "tags": 3.0, "content": 3.0, "properties": 2.0, "headings": 3.0}
BOOSTED_WEIGHTS = {"title": 10.0, "aliases": 9.0, "tags": 2.0, "content": 3.0, "properties": 2.0, "headings": 4.0}


@dataclass(frozen=True)
class RankingConfig:
    """Scoring weights. ``epsilon`` 0 turns date filters off but not the recency arm."""

    dense_weight: float = 0.85
    title_boost: float = 0.5
    recency_key: str = "modified"
    epsilon: float = 0.0
    half_life_days: float = 180.0
    k1: float = 1.2
    b: float = 0.75
    delta: float = 0.5
    coverage_power: float = 2.0
    fuzzy_weight: float = 0.45
    prefix_weight: float = 0.375
    synonym_weight: float = 0.8
    synonym_df: float = 0.05
    weights: dict[str, float] = field(default_factory=lambda: dict(FIELD_WEIGHTS))

    def __post_init__(self) -> None:
        if self.epsilon < 0 or self.half_life_days <= 0:
            raise ValueError("epsilon must be 0 or more and the half-life above 0")


@dataclass(frozen=True)
class FilterContext:
    """Which date property filters read (None: date filters are plain text) and which keys hold numbers."""

    date_field: str | None = None
    numeric_keys: frozenset[str] = frozenset()


#: Recency presets: (epsilon, half-life in days)
RECENCY_PRESETS = {"off": (0.0, 180.0), "default": (0.04, 180.0), "high": (0.1, 90.0)}


def nearest_preset(epsilon: float) -> str:
    return min(RECENCY_PRESETS, key=lambda k: abs(RECENCY_PRESETS[k][0] - epsilon))


def pool_cap(floor: int, ceiling: int, live: int, anchor: int = 5000) -> int:
    """Candidates an arm may bring: grows with the root of the corpus between floor and ceiling."""
    return max(floor, min(ceiling, round(floor * (max(live, 0) / anchor) ** 0.5)))


def pool_caps(live: int) -> dict[str, int]:
    return {"dense": pool_cap(200, 800, live), "lexical": pool_cap(100, 400, live), "recency": 50}


def migrate_settings(raw: dict, rules: list[tuple[int, object]]) -> dict:
    """Apply each (revision, rewrite) newer than the settings' own; never lower the revision."""
    out = dict(raw)
    for revision, rewrite in sorted(rules, key=lambda r: r[0]):
        if out.get("rev", 0) < revision:
            out = {**rewrite(out), "rev": revision}
    return out
