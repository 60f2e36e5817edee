"""Stateful streams: time differences and recursive least squares, a row at a time per unit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def time_differences(rows: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, t, d2) of a stream of (unit, t, y): the squared difference to the value before; the state is that value.

    Rows of a unit that arrive in one batch are ordered by t; a unit's first row gives none.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(parts).sort_values("t")
        y = part["y"].to_numpy()
        before = np.concatenate([[state.get[0] if state.exists else np.nan], y[:-1]])
        state.update((float(y[-1]),))
        out = pd.DataFrame({unit: key[0], "t": part["t"].to_numpy(), "d2": (y - before) ** 2})
        yield out[~np.isnan(out["d2"])]

    kind = rows.schema[unit].dataType.simpleString()
    return rows.groupBy(unit).applyInPandasWithState(step, f"{unit} {kind}, t long, d2 double", "last double", "append", GroupStateTimeout.NoTimeout)


def recursive_least_squares(rows: DataFrame, unit: str = "unit", prior: float = 1e8) -> DataFrame:
    """(unit, t, intercept, slope) of a stream of (unit, t, x, y): the fit of y on [1, x] after each row.

    The state is the coefficients and their covariance over the noise variance, which starts at prior times the identity.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(parts).sort_values("t")
        held = np.array(state.get) if state.exists else np.array([0.0, 0.0, prior, 0.0, prior])
        b, v = held[:2], np.array([[held[2], held[3]], [held[3], held[4]]])
        out = []
        for t, x, y in part[["t", "x", "y"]].itertuples(index=False):
            row = np.array([1.0, x])
            gain = v @ row / (1 + row @ v @ row)
            b = b + gain * (y - row @ b)
            v = v - np.outer(gain, row @ v)
            out.append((key[0], t, b[0], b[1]))
        state.update((float(b[0]), float(b[1]), float(v[0, 0]), float(v[0, 1]), float(v[1, 1])))
        yield pd.DataFrame(out, columns=[unit, "t", "intercept", "slope"])

    kind = rows.schema[unit].dataType.simpleString()
    return rows.groupBy(unit).applyInPandasWithState(step, f"{unit} {kind}, t long, intercept double, slope double", "b0 double, b1 double, v00 double, v01 double, v11 double", "append", GroupStateTimeout.NoTimeout)
