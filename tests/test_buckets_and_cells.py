import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlattice.functions import buckets as b
from barlattice.operators.cells import METRIC_COLS, CellSpace, Dim, bucket_stats, dense, outcome_inputs, small_cells, with_baseline
from barlattice.session import stage


def labels(spark, scheme, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r["l"] for r in df.select("i", scheme.label("v").alias("l")).orderBy("i").collect()]


def test_right_closed_rs_bins(spark):
    assert labels(spark, b.RS_DECILES, [0.0, 10.0, 10.001, 90.0, 100.0, None]) == [
        "0-10", "0-10", "10-20", "80-90", "90-100", None]
    assert labels(spark, b.RS_FINE, [79.9, 80.0, 82.5, 82.6, 100.0]) == [None, "80-82.5", "80-82.5", "82.5-85", "97.5-100"]


def test_left_closed_bins(spark):
    assert labels(spark, b.RS_CROSS, [0.0, 79.99, 80.0, 95.0, 97.5, 100.0]) == [
        "<80", "<80", "80-90", "95-97.5", "97.5-100", "97.5-100"]
    assert labels(spark, b.ATR_EXTENSION, [-0.1, 0.0, 2.0, 9.99, 10.0]) == ["<0", "0-2", "2-4", "8-10", ">=10"]
    assert labels(spark, b.EMA_DISTANCE, [-5.0, -5.1, 0.0, 10.0]) == ["-5% to -2%", "<-5%", "0% to +2%", ">=+10%"]
    assert labels(spark, b.PRIOR_EXTENSION, [3.99, 4.0, 8.0, 10.0]) == ["<4", "4-6", "8-10", ">=10"]
    assert labels(spark, b.EMA_DISTANCE_FINE, [-10.0, -7.5, -1.0, 0.0, 7.5]) == [
        "-10 to -7.5%", "-7.5 to -5%", "-1 to 0%", "0 to +1%", "+7.5 to +10%"]


def test_scheme_needs_matching_labels():
    with pytest.raises(ValueError):
        b.Scheme("x", (0, 1), ("a", "b"))


def study_frame(n=400, seed=6):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": rng.choice([0, 1, 3], n), "z": rng.normal(size=n)})
    for h in (5, 10):
        pdf[f"mfe_pct_{h}d"] = np.abs(rng.normal(size=n)) * 10
        pdf[f"mae_pct_{h}d"] = -np.abs(rng.normal(size=n)) * 10
        pdf[f"forward_return_close_{h}d"] = rng.normal(size=n)
        for c in outcome_inputs((h,)):
            if c not in pdf:
                pdf[c] = (rng.random(n) < 0.4).astype(float)
        gone = rng.random(n) < 0.1
        pdf.loc[gone, outcome_inputs((h,))] = np.nan
    return pdf


def test_bucket_stats_against_pandas(frame, spark):
    pdf = study_frame()
    df = stage(frame(pdf))
    space = CellSpace()
    space.add("all")
    space.add("cell", {"tag": "t"}, [Dim("k", ("zero", "one", "two", "three"), F.col("k"))])
    space.add("half", where=F.col("z") > 0)
    stats = stage(bucket_stats(df, space, (5, 10)))
    cells = space.frame(spark, "cell", {"tag": "string", "k": "string"}, {"all_id": lambda r: space.id_of("all")})
    out = with_baseline(dense(cells, stats, (5, 10)), stats, "all", "all_id").toPandas()
    assert len(out) == 8
    empty = out[out.k == "two"]
    assert (empty.n == 0).all() and empty[METRIC_COLS].isna().all().all()
    for i, name in ((0, "zero"), (1, "one"), (3, "three")):
        for h in (5, 10):
            r = out[(out.k == name) & (out.outcome_horizon == h)].iloc[0]
            g = pdf[pdf.k == i]
            assert r.n == len(g)
            m = g[f"mfe_pct_{h}d"]
            np.testing.assert_allclose(
                [r.median_mfe_pct, r.mean_mfe_pct, r.p75_mfe_pct, r.p90_mfe_pct],
                [m.median(), m.mean(), m.quantile(0.75), m.quantile(0.9)])
            np.testing.assert_allclose(r.reached_2atr_share, g[f"reached_2atr_{h}d"].mean())
            np.testing.assert_allclose(
                r.delta_vs_all_median_mae_pct, g[f"mae_pct_{h}d"].median() - pdf[f"mae_pct_{h}d"].median())
    half = stats.filter(F.col("cell_id") == space.id_of("half")).first()
    assert half["n"] == (pdf.z > 0).sum()
    assert small_cells(dense(cells, stats, (5,)), 1).count() == 1


def test_no_table_names_a_winner():
    words = ("best", "winner", "optimal", "rank", "score")
    assert not [m for m in METRIC_COLS if any(w in m for w in words)]
