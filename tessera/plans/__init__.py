"""Queries over the driver's tables, each built from the library's operators, with DuckDB SQL of the same rows."""

from __future__ import annotations

from tessera.plans import business, features, files, records, select, text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (features, records, select, text, files, business):
    QUERIES |= _module.Q
    ORACLES |= _module.S
