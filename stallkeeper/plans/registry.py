"""All registered queries."""

from stallkeeper.plans import (  # noqa: F401
    aggregates,
    builders,
    functions,
    inventory,
    joins,
    ordering,
    projections,
    quality,
    streams,
    tables,
)
from stallkeeper.plans.base import ORACLES, QUERIES  # noqa: F401
