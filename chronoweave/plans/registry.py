"""Named queries over the driver's tables and the DuckDB SQL that each must equal."""

from __future__ import annotations

from chronoweave.plans import checks, choices, ledger, records, signals, timelines

QUERIES = {}
ORACLES: dict[str, str] = {}
for part in (timelines, records, choices, ledger, signals, checks):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
