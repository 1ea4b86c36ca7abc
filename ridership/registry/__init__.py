"""The registered queries: each operator on the bound tables, next to the DuckDB text that gives the same rows."""

from ridership.registry import (  # noqa: F401  (importing a module registers its queries)
    cleaning,
    disruptions,
    enrichment,
    features,
    flows,
    geo,
    models,
    rollups,
    sources,
    streams,
    times,
    training,
)
from ridership.registry.base import ORACLES, QUERIES  # noqa: F401
