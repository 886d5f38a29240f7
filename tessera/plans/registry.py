"""All registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import company, funds, names, peers, records, statements, stocks, valuation
from tessera.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "company", "funds", "names", "peers", "records", "statements", "stocks", "valuation"]
