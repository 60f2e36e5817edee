"""Registered queries: each has a name, a function of (spark, sf_dir), and SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    from . import calibration, cliques, clusters, designs, fits, formulas, gammas, graphs, maps, masks, mixed, models, normals, nulls, regions, registration, regression, sampling, segmentation, series, space, spheres, splines, trends  # noqa: F401  they register on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
