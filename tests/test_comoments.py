"""Correlation by merged co-moments against the plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatica.operators import stats as S
from prismatica.operators.comoments import _stacked, correlations, merged, state_of


def pairwise(x):
    k, out = x.shape[1], {}
    for a in range(k):
        for b in range(a + 1, k):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            u, v = x[both, a], x[both, b]
            flat = len(u) == 0 or u.min() == u.max() or v.min() == v.max()
            out[a, b] = None if flat else float(np.corrcoef(u, v)[0, 1])
    return out


def table_of(spark, x):
    return spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x],
                                 ", ".join(f"`c.{i}` double" for i in range(x.shape[1])))


def odd(rng, n=500):
    x = rng.standard_normal((n, 7)) @ rng.standard_normal((7, 7))
    x[:, 1] = 0.1                                     # constant, not a binary fraction
    x[:, 2] += 1e9                                    # far from zero
    x[rng.random((n, 7)) < 0.2] = np.nan
    x[:, 4] = np.nan                                  # no values
    x[:, 5] = np.where(np.isnan(x[:, 3]), x[:, 5], 7.3)  # constant where column 3 is present
    x[3, 6] = 1e12                                    # an outlier
    return x


@pytest.mark.parametrize("cuts", [1, 3, 50])
def test_states_merge_to_the_whole(cuts):
    x = odd(np.random.default_rng(1))
    one, many = state_of(x), merged(_stacked([state_of(p) for p in np.array_split(x, cuts)]))
    for name in ("n", "mine", "its"):
        held = one["n"] > 0
        assert np.allclose(one[name][held], many[name][held], rtol=1e-12)
    assert np.allclose(one["both"], many["both"], rtol=1e-6, atol=1e-6 * np.abs(one["both"]).max())


def test_pairwise_complete_correlation(spark):
    x = odd(np.random.default_rng(2))
    df = table_of(spark, x).repartition(9)
    got = {(r["a"], r["b"]): r["correlation"] for r in correlations(df, [F.col(f"`{c}`") for c in df.columns]).collect()}
    want = pairwise(x)
    assert got.keys() == want.keys()
    for pair, r in want.items():
        assert (got[pair] is None) == (r is None) and (r is None or got[pair] == pytest.approx(r, abs=1e-6)), pair


def test_two_hundred_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 200)) + rng.standard_normal((300, 200))
    df = table_of(spark, x).repartition(4)
    found = S.correlation_pairs(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan
    rows = found.collect()
    want = np.corrcoef(x.T)
    assert len(rows) == 199 * 100
    assert all(r["correlation"] == pytest.approx(want[int(r["feature_a"][2:]), int(r["feature_b"][2:])], abs=1e-9) for r in rows)


def test_correlation_of_few_rows_and_columns(spark):
    schema = "a double, b double, c string"
    assert S.correlation_pairs(spark.createDataFrame([], schema)).select("correlation").collect() == [(None,)]
    assert S.correlation_pairs(spark.createDataFrame([(1.0, 2.0, "x")], schema)).first()["correlation"] is None
    assert S.correlation_pairs(spark.createDataFrame([(1.0, 2.0, "x")], schema), ["a"]).collect() == []
    two = spark.createDataFrame([(1.0, 2.0, "x"), (2.0, 1.0, "y"), (float("nan"), 9.0, "z"), (None, None, None)], schema)
    assert S.correlation_pairs(two).first()["correlation"] == pytest.approx(-1.0)
