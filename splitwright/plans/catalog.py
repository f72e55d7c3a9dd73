"""All queries and SQL checks by name."""

from __future__ import annotations

import importlib

AREAS = ("names", "registry", "splits", "similarity", "leakage", "profiles", "metrics", "files")
QUERIES: dict = {}
ORACLES: dict = {}
for _area in AREAS:
    _module = importlib.import_module(f"splitwright.plans.{_area}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.SQL)


def flagship(spark, sf_dir):
    return QUERIES["cluster_balance"](spark, sf_dir)
