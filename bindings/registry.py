"""All registered queries and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("pii", "files", "facts", "patterns", "io")

QUERIES: dict = {}
ORACLES: dict = {}
for _m in _MODULES:
    QUERIES.update(import_module(f"bindings.q_{_m}").QUERIES)
    ORACLES.update(import_module(f"bindings.oracles.{_m}").ORACLES)
