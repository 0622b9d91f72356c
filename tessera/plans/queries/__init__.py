"""All registered queries; importing a module registers its own."""

from tessera.plans.queries import clustering, crosssection, decisions, evaluation, factors, incremental, indicators, inference, joins, learning, monitoring, optimization, pools, portfolio, recursions, relational, risk, statistics, streams, textual, timeseries, validation  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
