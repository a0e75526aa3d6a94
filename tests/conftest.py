import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barlattice.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", partitions=4, memory="6g")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """pandas -> Spark with NaN as NULL and datetimes as dates."""

    def make(pdf: pd.DataFrame):
        pdf = pdf.copy()
        for c in pdf.columns:
            if str(pdf[c].dtype).startswith("datetime"):
                pdf[c] = pdf[c].dt.date
        from pyspark.sql import functions as F

        df = spark.createDataFrame(pdf)
        doubles = [c for c, t in df.dtypes if t == "double"]
        return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles}) if doubles else df

    return make


@pytest.fixture
def collected():
    """Spark -> pandas, sorted by the given columns."""

    def take(df, *by):
        out = df.toPandas()
        return out.sort_values(list(by)).reset_index(drop=True) if by else out

    return take


def ohlcv(n_days=80, tickers=("AAA", "BBB"), seed=7, start="2023-01-02"):
    """Seeded random walks on business days."""
    import numpy as np

    rng = np.random.default_rng(seed)
    out = []
    for t in tickers:
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, n_days)))
        spread = rng.uniform(0.005, 0.05, n_days)
        out.append(pd.DataFrame({
            "date": pd.bdate_range(start, periods=n_days), "ticker": t,
            "open": close * (1 + rng.normal(0, 0.01, n_days)), "high": close * (1 + spread),
            "low": close * (1 - spread), "close": close, "volume": rng.integers(1000, 9000, n_days).astype(float),
        }))
    return pd.concat(out, ignore_index=True)
