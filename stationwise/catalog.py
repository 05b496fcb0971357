"""Every registered query and its SQL."""

from __future__ import annotations

from stationwise.operators import clusters, designs, diagnostics, estimators, filters, gaps, inference, panel, regression, sampling, spatial, stats, tables  # noqa: F401  register their queries
from stationwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
