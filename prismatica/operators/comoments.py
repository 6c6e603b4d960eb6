"""Correlation of many columns in one scan, by co-moments that can be merged.

A task turns each Arrow batch into matrices with one entry per pair of columns
(a, b): how many rows hold both, the mean of a over those, and the centred sums of
a a and a b. Such states are merged, within a task, among up to 512 tasks and at
last per column, so no row is ever expanded into its pairs, and what is shuffled
grows with columns and tasks only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tasks whose states are merged in the first of two levels.
FAN = 512
# Spread in relation to the mean up to which a column counts as constant: rounding of the mean.
FLAT = 1e-13

STATE = ("n", "mine", "its", "own", "other", "both")
SCHEMA = ", ".join(["part int", "a int", *[f"{name} array<double>" for name in STATE]])


def state_of(x: np.ndarray) -> dict[str, np.ndarray]:
    """State of the rows of ``x``, NaN for missing. Entry (a, b): n rows with both, ``mine`` and ``its`` the
    means of a and b, ``own`` and ``other`` their centred squares, ``both`` their centred product."""
    held = ~np.isnan(x)
    # Centred on a value of the middle, so an outlier costs no digits and a constant gives zeros.
    middle = np.zeros(x.shape[1])
    for k in range(x.shape[1]):
        values = x[held[:, k], k]
        if len(values):
            middle[k] = np.partition(values, len(values) // 2)[len(values) // 2]
    z, there = np.where(held, x - middle, 0.0), held.astype(float)
    n, sums, squares, products = there.T @ there, z.T @ there, (z * z).T @ there, z.T @ z
    rows = np.maximum(n, 1)
    own = np.maximum(squares - sums * sums / rows, 0.0)
    own[own <= FLAT * sums * sums / rows] = 0.0
    mine = middle[:, None] + sums / rows
    return {"n": n, "mine": mine, "its": mine.T, "own": own, "other": own.T, "both": products - sums * sums.T / rows}


def merged(states: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One state of many; the first axis numbers them."""
    n = states["n"].sum(0)
    rows = np.maximum(n, 1)
    mine, its = ((states["n"] * states[name]).sum(0) / rows for name in ("mine", "its"))
    # Where a state has no rows its means say nothing.
    there = states["n"] > 0
    dx, dy = np.where(there, states["mine"] - mine, 0.0), np.where(there, states["its"] - its, 0.0)
    return {"n": n, "mine": mine, "its": its, "own": (states["own"] + states["n"] * dx * dx).sum(0),
            "other": (states["other"] + states["n"] * dy * dy).sum(0), "both": (states["both"] + states["n"] * dx * dy).sum(0)}


def _stacked(many: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {name: np.stack([s[name] for s in many]) for name in STATE}


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of a task, a row per column."""
    kept = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        if len(x):
            with np.errstate(over="ignore", invalid="ignore"):
                kept = state_of(x) if kept is None else merged(_stacked([kept, state_of(x)]))
    if kept is not None:
        task, k = TaskContext.get(), len(kept["n"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, (task.partitionId() if task else 0) // FAN, np.int32)), pa.array(np.arange(k, dtype=np.int32)),
             *[pa.array(list(kept[name])) for name in STATE]], names=["part", "a", *STATE])


def _together(table: pa.Table) -> dict[str, np.ndarray]:
    with np.errstate(over="ignore", invalid="ignore"):
        return merged({name: np.stack([np.array(v) for v in table.column(name).to_pylist()]) for name in STATE})


def _merged(table: pa.Table) -> pa.Table:
    """One row of the rows of a column in a group of tasks."""
    one = _together(table)
    return pa.table([table.column("part")[:1], table.column("a")[:1], *[pa.array([one[name]]) for name in STATE]], names=["part", "a", *STATE])


def _correlated(table: pa.Table) -> pa.Table:
    """(a, b, n, correlation) of a column with those after it; null where either is constant."""
    a, one = table.column("a")[0].as_py(), _together(table)
    with np.errstate(all="ignore"):
        flat = [np.sqrt(one[square] / one["n"]) <= FLAT * np.abs(one[mean]) for square, mean in (("own", "mine"), ("other", "its"))]
        r = np.clip(one["both"] / np.sqrt(one["own"]) / np.sqrt(one["other"]), -1.0, 1.0)
    r[(one["n"] == 0) | flat[0] | flat[1] | ~np.isfinite(r)] = np.nan
    r, b = r[a + 1:], np.arange(a + 1, len(r), dtype=np.int32)
    return pa.table([pa.array(np.full(len(r), a, np.int32)), pa.array(b), pa.array(one["n"][a + 1:].astype(np.int64)), pa.array(r, from_pandas=True)],
                    names=["a", "b", "n", "correlation"])


def correlations(df: DataFrame, values: list[Column]) -> DataFrame:
    """(a, b, n, correlation), a < b, of every two of ``values`` over the rows that hold both: how many those
    are, and Pearson's coefficient, null where either is constant. Null values are left out; an empty table
    gives no rows. One scan."""
    plain = df.select(*[v.cast("double").alias(f"x{i}") for i, v in enumerate(values)])
    states = plain.mapInArrow(_states, SCHEMA).groupBy("part", "a").applyInArrow(_merged, SCHEMA)
    return states.groupBy("a").applyInArrow(_correlated, "a int, b int, n long, correlation double")
