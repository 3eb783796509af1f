"""All registered queries of the library; importing the modules fills the registry."""

from __future__ import annotations

from quire.plans import analytics, numerics, records, relational, texts
from quire.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "numerics", "records", "relational", "texts"]
