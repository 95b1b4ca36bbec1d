"""All image and transformation queries by name, with the SQL that a second engine can run for them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("similarity", "points", "measuring", "stencils", "resampling", "transforms", "estimates", "regularisers", "velocities", "comparisons", "groups", "streams", "pairs", "jacobians", "folds", "tensors")
PLANS: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

for _module in MODULES:
    for _name, _query, _sql in import_module(f"{__package__}.{_module}").QUERIES:
        if _name in PLANS:
            raise ValueError(f"two queries are named {_name}")
        PLANS[_name] = _query
        if _sql:
            ORACLES[_name] = _sql

flagship = PLANS["w_similarity_pairs"]
