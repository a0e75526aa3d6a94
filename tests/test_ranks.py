import numpy as np
import pandas as pd

from barlattice.operators.bins import _edges
from barlattice.operators.ranks import rank_percentiles
from barlattice.plans.panel import with_ranks


def expect(pdf, col):
    return pdf.groupby("date")[col].rank(pct=True, method="average") * 100


def check(frame, collected, pdf, pieces):
    out = collected(rank_percentiles(frame(pdf), {"pa": "a", "pb": "b"}, pieces=pieces), "date", "ticker")
    pdf = pdf.sort_values(["date", "ticker"]).reset_index(drop=True)
    got = pdf[["date", "ticker"]].merge(
        out.assign(date=pd.to_datetime(out.date)), on=["date", "ticker"], how="left")
    np.testing.assert_allclose(got.pa, expect(pdf, "a"), atol=1e-9)
    np.testing.assert_allclose(got.pb, expect(pdf, "b"), atol=1e-9)


def test_average_ranks_with_ties_and_missing(frame, collected):
    rng = np.random.default_rng(1)
    n = 4000
    pdf = pd.DataFrame({
        "date": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 4, n), unit="D"),
        "ticker": np.arange(n), "a": rng.normal(size=n), "b": rng.integers(0, 9, n).astype(float),
    })
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    check(frame, collected, pdf, 32)


def test_hot_date_and_hot_value(frame, collected):
    """A third of all rows on one date, and a third of all values equal."""
    rng = np.random.default_rng(2)
    n = 3000
    day = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({
        "date": pd.to_datetime("2024-01-01") + pd.to_timedelta(day, unit="D"), "ticker": np.arange(n),
        "a": np.where(rng.random(n) < 0.34, 0.0, rng.normal(size=n)), "b": np.full(n, 5.0),
    })
    for pieces in (2, 16, 256):
        check(frame, collected, pdf, pieces)


def test_heavy_values_get_bins_of_their_own():
    e = _edges(np.array([1.0, 2.0, 2.0, 2.0, 3.0]))
    assert e.edges.tolist() == [1.0, np.nextafter(2.0, 0), 2.0, 3.0]
    assert e.pure == (2,)  # (below 2, 2] holds the value 2 alone


def test_only_eligible_rows_compete(frame, collected):
    d = pd.to_datetime("2024-01-01")
    pdf = pd.DataFrame({
        "date": [d] * 4, "ticker": ["A", "B", "C", "D"], "return_21d": [1.0, 2.0, 3.0, 99.0],
        "eligible": [True, True, True, False],
    })
    out = collected(with_ranks(frame(pdf), {"rs_percentile_1m": "return_21d"}), "ticker")
    np.testing.assert_allclose(out.rs_percentile_1m[:3], [100 / 3, 200 / 3, 100.0])
    assert np.isnan(out.rs_percentile_1m[3])


def test_dates_are_ranked_apart(frame, collected):
    a, b = pd.to_datetime("2024-01-01"), pd.to_datetime("2024-01-02")
    pdf = pd.DataFrame({"date": [a, a, b, b], "ticker": [1, 2, 1, 2], "x": [1.0, 2.0, 200.0, 100.0]})
    out = collected(rank_percentiles(frame(pdf), {"p": "x"}), "date", "ticker")
    assert out.p.tolist() == [50.0, 100.0, 100.0, 50.0]


def test_pieces_grow_with_the_rows_and_no_piece_outgrows_its_share(spark):
    """One date holds half of all rows, with values in a narrow band."""
    from barlattice.operators.bins import pieces_for, value_edges

    n = 4000
    rows = spark.range(n).selectExpr(
        "if(id % 2 = 0, 0, id % 50 + 1) AS date", "id AS ticker", "if(id % 2 = 0, 5 + id / 1e9, id * 1.0) AS x").cache()
    pieces = pieces_for(rows, least=8, piece_rows=100)
    assert pieces == 40
    edges = value_edges(rows, {"x": "x"}, pieces)["x"]
    largest = rows.groupBy("date", edges.bin_of(rows["x"]).alias("b")).count().agg({"count": "max"}).first()[0]
    assert largest <= 1.3 * n / pieces
    few = {(r["date"], r["ticker"]): r["p"] for r in rank_percentiles(rows, {"p": "x"}, pieces=8).collect()}
    many = {(r["date"], r["ticker"]): r["p"] for r in rank_percentiles(rows, {"p": "x"}, pieces=pieces).collect()}
    assert few == many and len(few) == n
