"""Queries over the driver's tables, one or more for each operator, and the SQL that checks them."""

from __future__ import annotations

from . import catalogs, graphs, kernels, matrices, motion, pathways, sequences

_PARTS = (catalogs, motion, matrices, graphs, sequences, kernels, pathways)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
