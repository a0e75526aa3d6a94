import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlattice.operators.quantiles import code_rows, wide_quantiles
from barlattice.operators.quality import quantile_buckets
from barlattice.session import stage


@pytest.mark.parametrize("pieces", [4, 64])
@pytest.mark.parametrize("few", [True, False])
def test_equals_pandas_quantiles(frame, pieces, few):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 7, n)),
        "x": np.where(rng.random(n) < 0.35, 0.0, rng.standard_t(2, n)), "y": rng.integers(0, 5, n).astype(float),
    })
    pdf.loc[rng.random(n) < 0.2, "y"] = np.nan
    coded = code_rows(stage(frame(pdf)), {"g": "g"}, ["x", "y"], pieces=pieces)
    out = wide_quantiles(coded, {"m": ("x", 0.5), "p90": ("x", 0.9), "y75": ("y", 0.75), "lo": ("x", 0.025)}, few)
    out = out.toPandas().set_index("g").sort_index()
    by = pdf.groupby("g")
    np.testing.assert_allclose(out.m, by.x.quantile(0.5), atol=1e-12)
    np.testing.assert_allclose(out.p90, by.x.quantile(0.9), atol=1e-12)
    np.testing.assert_allclose(out.lo, by.x.quantile(0.025), atol=1e-12)
    np.testing.assert_allclose(out.y75, by.y.quantile(0.75), atol=1e-12)


def test_rows_may_belong_to_many_groups(frame):
    pdf = pd.DataFrame({"x": np.arange(10.0)})
    ids = F.array_compact(F.array(F.lit(0), F.when(F.col("x") >= 5, 1), F.when(F.col("x") == 3, 2)))
    out = wide_quantiles(code_rows(stage(frame(pdf)), {"g": ids}, ["x"]), {"m": ("x", 0.5)}).toPandas()
    assert dict(zip(out.g, out.m)) == {0: 4.5, 1: 7.0, 2: 3.0}


def test_quantile_buckets_follow_qcut(frame):
    rng = np.random.default_rng(4)
    n = 500
    pdf = pd.DataFrame({"v": np.where(rng.random(n) < 0.3, 1.0, rng.normal(size=n)), "o": rng.normal(size=n)})
    pdf.loc[:20, "v"] = np.nan
    out = quantile_buckets(stage(frame(pdf)), "v", ["o"], "b").toPandas().sort_values("b_bucket")
    have = pdf.dropna(subset=["v"])
    cats = pd.qcut(have.v, 10, duplicates="drop")
    want = have.groupby(cats, observed=True).o.agg(["median", "size"])
    assert out.n.tolist() == want["size"].tolist()
    np.testing.assert_allclose(out.o, want["median"], atol=1e-12)


def test_quantile_buckets_of_nothing(frame):
    pdf = pd.DataFrame({"v": [np.nan, np.nan], "o": [1.0, 2.0]})
    assert quantile_buckets(stage(frame(pdf)), "v", ["o"], "b").count() == 0
