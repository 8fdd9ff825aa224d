"""The registered queries, each next to the SQL that must give the same table."""

from __future__ import annotations

from workload.registry import REGISTRY, Entry

from workload import (  # noqa: E402,F401  (importing a module registers its queries)
    accounting,
    aggregates,
    bounding,
    distances,
    grids,
    joins,
    scalars,
    sessions,
    sources,
    trials,
)

__all__ = ["REGISTRY", "Entry"]
