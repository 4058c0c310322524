"""Queries of the laboratory-results domain, and DuckDB SQL with the same answers."""

from __future__ import annotations

from sparrowmill.plans import actions, chain, fraud, inputs, names, risk, runs, standard, stores, texts

_PARTS = (risk, standard, fraud, chain, inputs, runs, actions, names, stores, texts)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
