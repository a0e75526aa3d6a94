"""Bucket-by-outcome studies. Each takes staged eligible rows and returns its tables.

A study first lists its cells, then computes the statistics of all of them together; the
tables are different views of those statistics with their baselines attached. No study
ranks, selects or flags a best cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..config import DEFAULT, StudyConfig
from ..functions.buckets import (
    ATR_EXTENSION,
    EMA_DISTANCE,
    EMA_DISTANCE_FINE,
    PRIOR_EXTENSION,
    RS_CROSS,
    RS_DECILES,
    RS_FINE,
    Scheme,
)
from ..functions.scalar import flag, pct_of
from ..operators.cells import (
    METRIC_COLS,
    CellSpace,
    Dim,
    baseline_columns,
    bucket_stats,
    dense,
    outcome_inputs,
    with_baseline,
)
from ..operators.classify import common_sample, high_rs, is_resetting, state_ordinal
from ..operators.quality import as_rows
from ..operators.quantiles import code_rows, wide_quantiles
from ..session import stage

EMAS = ("10", "20")


def dim(name: str, scheme: Scheme, column: str) -> Dim:
    return Dim(name, scheme.labels, scheme.ordinal(column))


def needed(rows: DataFrame, columns, horizons) -> DataFrame:
    """Only the columns a study reads, so that staging and later passes stay narrow."""
    return rows.select(*dict.fromkeys([*columns, *outcome_inputs(horizons)]))


def coverage_rows(rows: DataFrame, rs_horizons, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """(metric, key, value): eligible total, non-null and high counts per RS horizon with percents."""
    total = F.count(F.lit(1))
    sums = rows.agg(
        total.alias("total"),
        *[F.count(r).alias(f"n_{r}") for r in rs_horizons],
        *[F.count_if(high_rs(r, conf)).alias(f"high_{r}") for r in rs_horizons],
    )
    slots = [F.struct(F.lit("n_eligible_total").alias("metric"), F.lit(None).cast("string").alias("key"),
                      F.col("total").cast("double").alias("value"))]
    for r in rs_horizons:
        for metric, value in (
            ("rs_coverage_n", F.col(f"n_{r}").cast("double")),
            ("rs_coverage_pct", pct_of(F.col(f"n_{r}"), F.col("total"))),
            ("high_rs_n", F.col(f"high_{r}").cast("double")),
            ("high_rs_pct_of_eligible", pct_of(F.col(f"high_{r}"), F.col("total"))),
        ):
            slots.append(F.struct(F.lit(metric).alias("metric"), F.lit(r).alias("key"), value.alias("value")))
    return sums.select(F.explode(F.array(*slots)).alias("s")).select("s.*")


def small_sample_rows(tables: dict[str, DataFrame], conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """(metric, key, value): how many cells of each table have fewer rows than the limit."""
    out = None
    for name, table in tables.items():
        n = "n" if "n" in table.columns else "n_in_range"
        one = as_rows(
            table.agg(F.count_if(F.col(n) < conf.small_sample).alias("k")), {"small_sample_cells": "k"}, F.lit(name)
        )
        out = one if out is None else out.unionByName(one)
    return out


# --- RS benchmark -----------------------------------------------------------------


def rs_benchmark(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """Every RS horizon x bucket scheme x bucket x outcome horizon as one long table."""
    space = CellSpace()
    for rs in conf.rs_horizons:
        for scheme in (RS_DECILES, RS_FINE):
            space.add("benchmark", {"rs_horizon": rs, "scheme": scheme.name}, [dim("bucket", scheme, rs)])
    stats = bucket_stats(rows, space, conf.outcome_horizons)
    cells = space.frame(rows.sparkSession, "benchmark",
                        {"rs_horizon": "string", "scheme": "string", "bucket": "string"})
    return dense(cells, stats, conf.outcome_horizons).select(
        "rs_horizon", "scheme", "outcome_horizon", "bucket", "n", *METRIC_COLS
    )


def rs_benchmark_common(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """The benchmark on the fixed set of rows that have all six percentiles."""
    return rs_benchmark(rows.filter(common_sample(conf.rs_horizons)), conf)


def common_sample_summary(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    counts = rows.agg(
        F.count_if(common_sample(conf.rs_horizons)).alias("n_common_sample"),
        F.count(F.lit(1)).alias("n_full_eligible"),
    )
    return counts.withColumn("retained_pct", pct_of(F.col("n_common_sample"), F.col("n_full_eligible")))


# --- RS x ATR extension -----------------------------------------------------------


def rs_atr_study(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> dict[str, DataFrame]:
    """cross_matrix, rs_bucket_baseline and universe_baseline."""
    spark, hs = rows.sparkSession, conf.outcome_horizons
    space = CellSpace()
    space.add("universe")
    for rs in conf.rs_horizons:
        space.add("marginal", {"rs_horizon": rs}, [dim("rs_bucket", RS_CROSS, rs)])
        space.add("cross", {"rs_horizon": rs},
                  [dim("rs_bucket", RS_CROSS, rs), dim("atr_bucket", ATR_EXTENSION, "atr_extension")])
    stats = stage(bucket_stats(rows, space, hs), "stats")
    cross = dense(
        space.frame(spark, "cross", {"rs_horizon": "string", "rs_bucket": "string", "atr_bucket": "string"}, {
            "universe_id": lambda r: space.id_of("universe"),
            "marginal_id": lambda r: space.id_of("marginal", rs_horizon=r["rs_horizon"], rs_bucket=r["rs_bucket"]),
        }), stats, hs)
    cross = with_baseline(with_baseline(cross, stats, "universe", "universe_id"), stats, "rs_bucket", "marginal_id")
    marginal = dense(space.frame(spark, "marginal", {"rs_horizon": "string", "rs_bucket": "string"}), stats, hs)
    universe = dense(space.frame(spark, "universe", {}), stats, hs)
    return {
        "cross_matrix": cross.select(
            "rs_horizon", "outcome_horizon", "rs_bucket", "atr_bucket", "n", *METRIC_COLS,
            *baseline_columns("universe"), *baseline_columns("rs_bucket"),
        ),
        "rs_bucket_baseline": marginal.select("rs_horizon", "outcome_horizon", "rs_bucket", "n", *METRIC_COLS),
        "universe_baseline": universe.select("outcome_horizon", "n", *METRIC_COLS),
    }


# --- Opportunity states -----------------------------------------------------------


def opportunity_study(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> dict[str, DataFrame]:
    """RS x EMA distance, prior extension x EMA distance, and the repeat-offender cohort.

    `rows` are the year's eligible rows with prior-extension history.
    """
    spark, hs = rows.sparkSession, conf.outcome_horizons
    prior = dim("prev_ext_bucket", PRIOR_EXTENSION, "atr_extension_peak")
    ema_dims = {e: dim(f"ema{e}_bucket", EMA_DISTANCE, f"distance_ema{e}_pct") for e in EMAS}
    space = CellSpace()
    space.add("universe")
    for e in EMAS:
        space.add(f"ema{e}", {}, [ema_dims[e]])
        space.add(f"prior_x_ema{e}", {}, [prior, ema_dims[e]])
    for rs in conf.state_rs_horizons:
        bucket, strong = dim("rs_bucket", RS_CROSS, rs), high_rs(rs, conf)
        space.add("rs_marginal", {"rs_horizon": rs}, [bucket])
        space.add("cohort", {"rs_horizon": rs}, where=strong)
        for e in EMAS:
            space.add(f"rs_x_ema{e}", {"rs_horizon": rs}, [bucket, ema_dims[e]])
            space.add(f"repeat_ema{e}", {"rs_horizon": rs}, [prior, ema_dims[e]], where=strong)
    # The median current RS of a cell is taken from the RS horizon the cell belongs to.
    stats = stage(
        bucket_stats(rows, space, hs, {f"_median_{rs}": rs for rs in conf.state_rs_horizons}), "stats"
    )
    own_rs = F.coalesce(*[F.when(F.col("rs_horizon") == rs, F.col(f"_median_{rs}")) for rs in conf.state_rs_horizons])

    universe_id = lambda r: space.id_of("universe")
    tables = {}
    for e in EMAS:
        b = f"ema{e}_bucket"
        cells = space.frame(spark, f"rs_x_ema{e}", {"rs_horizon": "string", "rs_bucket": "string", b: "string"}, {
            "universe_id": universe_id,
            "marginal_id": lambda r: space.id_of("rs_marginal", rs_horizon=r["rs_horizon"], rs_bucket=r["rs_bucket"]),
        })
        t = with_baseline(dense(cells, stats, hs), stats, "universe", "universe_id")
        tables[f"rs_x_ema{e}"] = with_baseline(t, stats, "rs_bucket", "marginal_id").select(
            "rs_horizon", "outcome_horizon", "rs_bucket", b, "n", *METRIC_COLS,
            *baseline_columns("universe"), *baseline_columns("rs_bucket"),
        )
        cells = space.frame(spark, f"prior_x_ema{e}", {"prev_ext_bucket": "string", b: "string"}, {
            "universe_id": universe_id,
            "marginal_id": lambda r, e=e, b=b: space.id_of(f"ema{e}", **{b: r[b]}),
        })
        t = with_baseline(dense(cells, stats, hs), stats, "universe", "universe_id")
        tables[f"prior_extension_x_ema{e}"] = with_baseline(t, stats, "ema_bucket", "marginal_id").select(
            "outcome_horizon", "prev_ext_bucket", b, "n", *METRIC_COLS,
            *baseline_columns("universe"), *baseline_columns("ema_bucket"),
        )
        cells = space.frame(
            spark, f"repeat_ema{e}", {"rs_horizon": "string", "prev_ext_bucket": "string", b: "string"}, {
                "universe_id": universe_id,
                "cohort_id": lambda r: space.id_of("cohort", rs_horizon=r["rs_horizon"]),
                # The control: cohort rows whose prior peak stayed below 4, same EMA bucket.
                "control_id": lambda r, e=e, b=b: space.id_of(
                    f"repeat_ema{e}", rs_horizon=r["rs_horizon"], prev_ext_bucket="<4", **{b: r[b]}
                ),
            })
        # An RS horizon without any cohort row has no table part.
        alive = stats.select(F.col("cell_id").alias("cohort_id")).distinct()
        t = dense(cells.join(alive, "cohort_id", "left_semi"), stats, hs)
        t = with_baseline(t, stats, "universe", "universe_id")
        t = with_baseline(t, stats, "rs_ge90_cohort", "cohort_id")
        tables[f"repeat_offender_ema{e}"] = with_baseline(t, stats, "no_prior_extension_control", "control_id").select(
            "rs_horizon", "outcome_horizon", "prev_ext_bucket", b, "n", *METRIC_COLS,
            *baseline_columns("universe"), *baseline_columns("rs_ge90_cohort"),
            *baseline_columns("no_prior_extension_control"), own_rs.alias("median_current_rs_in_cell"),
        )
    return tables


def prior_extension_coverage(rows: DataFrame) -> DataFrame:
    """Rows with a prior peak, their percent, and rows whose lookback held fewer values than the fullest."""
    full = rows.agg(F.max("n_valid_days_prior_peak_window").alias("m")).scalar()
    sums = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("atr_extension_peak").alias("n_with_valid_peak"),
        F.count_if(F.col("n_valid_days_prior_peak_window") < full).alias("n_with_partial_lookback_window"),
    ).withColumn("pct_with_valid_peak", pct_of(F.col("n_with_valid_peak"), F.col("total")))
    return as_rows(sums, {c: c for c in (
        "n_with_valid_peak", "pct_with_valid_peak", "n_with_partial_lookback_window")})


# --- Candidate states -------------------------------------------------------------


def candidate_states(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> dict[str, DataFrame]:
    """State x RS bucket per EMA, with the universe and the RS-bucket baselines."""
    spark, hs = rows.sparkSession, conf.outcome_horizons
    space = CellSpace()
    space.add("universe")
    for rs in conf.state_rs_horizons:
        bucket = dim("rs_bucket", RS_CROSS, rs)
        space.add("rs_marginal", {"rs_horizon": rs}, [bucket])
        for e in EMAS:
            state = Dim("candidate_state", cfg.CANDIDATE_STATES, state_ordinal(e, conf))
            space.add(f"states_ema{e}", {"rs_horizon": rs}, [bucket, state])
    stats = stage(bucket_stats(rows, space, hs), "stats")
    tables = {}
    for e in EMAS:
        cells = space.frame(
            spark, f"states_ema{e}", {"rs_horizon": "string", "rs_bucket": "string", "candidate_state": "string"}, {
                "universe_id": lambda r: space.id_of("universe"),
                "marginal_id": lambda r: space.id_of("rs_marginal", rs_horizon=r["rs_horizon"], rs_bucket=r["rs_bucket"]),
            })
        t = with_baseline(dense(cells, stats, hs), stats, "universe", "universe_id")
        tables[f"candidate_states_by_rs_bucket_ema{e}"] = with_baseline(t, stats, "rs_bucket", "marginal_id").select(
            "rs_horizon", "outcome_horizon", "rs_bucket", "candidate_state", "n", *METRIC_COLS,
            *baseline_columns("universe"), *baseline_columns("rs_bucket"),
        )
    return tables


def state_population(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """(ema, candidate_state, n), including the rows that cannot be classified."""
    labels = cfg.CANDIDATE_STATES + ("unclassified_missing_current_extension",)
    counts = rows.agg(*[
        F.count_if(F.coalesce(state_ordinal(e, conf), F.lit(len(labels) - 1)) == i).alias(f"k_{e}_{i}")
        for e in EMAS for i in range(len(labels))
    ])
    slots = F.array(*[
        F.struct(F.lit(f"ema{e}").alias("ema"), F.lit(name).alias("candidate_state"), F.col(f"k_{e}_{i}").alias("n"))
        for e in EMAS for i, name in enumerate(labels)
    ])
    return counts.select(F.explode(slots).alias("s")).select("s.*")


# --- EMA pullback ranges ----------------------------------------------------------

# Push name -> race column stem; overlapping RS slices.
PUSHES = {
    "plus5_before_minus5": "reached_plus_5_before_minus_5",
    "plus10_before_minus5": "reached_plus_10_before_minus_5",
}
SLICES = ("RS>=90", "90-95", "95-97.5", "97.5-100")
# End of fixed values.


def in_slice(rs: str, name: str, conf: StudyConfig = DEFAULT.study) -> Column:
    if name == "RS>=90":
        return high_rs(rs, conf)
    return F.coalesce(RS_CROSS.ordinal(rs) == RS_CROSS.labels.index(name), F.lit(False))


def strong_rows(rows: DataFrame, columns, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """One row per (EMA, RS horizon) an eligible row is strong in and not Resetting for.

    Eight candidates per input row, of which those below the RS level fall away at once.
    Columns: _ema and _rs (ordinals), dist (the EMA's distance), rs (the percentile).
    """
    cases = F.array(*[
        F.struct(F.lit(i).alias("_ema"), F.lit(j).alias("_rs"), F.col(f"distance_ema{e}_pct").alias("dist"),
                 F.col(rs).alias("rs"), is_resetting(e, conf).alias("out"))
        for i, e in enumerate(EMAS) for j, rs in enumerate(conf.state_rs_horizons)
    ])
    kept = F.filter(cases, lambda s: ~s["out"] & (s["rs"] >= conf.high_rs))
    return rows.select(F.explode(kept).alias("s"), *columns).select("s._ema", "s._rs", "s.dist", "s.rs", *columns)


def _strong_dims(conf: StudyConfig) -> list[Dim]:
    return [Dim("ema", EMAS, F.col("_ema")), Dim("rs_horizon", conf.state_rs_horizons, F.col("_rs"))]


def push_distribution(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """Percentiles of the EMA distance among rows whose push succeeded, per slice and horizon."""
    races = [f"{stem}_{h}d" for stem in PUSHES.values() for h in conf.outcome_horizons]
    strong = strong_rows(rows, races, conf)
    space = CellSpace()
    for name in SLICES:
        for h in conf.outcome_horizons:
            for push, stem in PUSHES.items():
                space.add("push", {"rs_population_slice": name, "h": str(h), "push_type": push}, _strong_dims(conf),
                          where=in_slice("rs", name, conf) & (F.col(f"{stem}_{h}d") == 1.0))
    names = dict(zip(cfg.PULLBACK_PERCENTILE_NAMES, cfg.PULLBACK_PERCENTILES))
    coded = code_rows(strong, {"cell_id": space.ids()}, ["dist"])
    counts = coded.totals(n=F.col("dist").isNotNull().cast("long"))
    stats = counts.join(wide_quantiles(coded, {n: ("dist", p / 100.0) for n, p in names.items()}), "cell_id", "left")
    cells = space.frame(rows.sparkSession, "push", {
        "ema": "string", "rs_horizon": "string", "rs_population_slice": "string", "h": "string", "push_type": "string"})
    out = cells.join(stats, "cell_id", "left")
    return out.select(
        "ema", "rs_horizon", "rs_population_slice", F.col("h").cast("int").alias("outcome_horizon"), "push_type",
        F.coalesce("n", F.lit(0)).alias("n"), *names,
        F.col("p10").alias("range80_lo"), F.col("p90").alias("range80_hi"),
        F.col("p5").alias("range90_lo"), F.col("p95").alias("range90_hi"),
        F.col("p2_5").alias("range95_lo"), F.col("p97_5").alias("range95_hi"),
    )


def distance_buckets(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """The 14 metrics over 14 fine EMA-distance bins per slice, Resetting rows left out."""
    strong = strong_rows(rows, outcome_inputs(conf.outcome_horizons), conf)
    space = CellSpace()
    for name in SLICES:
        space.add("fine", {"rs_population_slice": name},
                  _strong_dims(conf) + [dim("distance_bucket", EMA_DISTANCE_FINE, "dist")],
                  where=in_slice("rs", name, conf))
    stats = bucket_stats(strong, space, conf.outcome_horizons)
    cells = space.frame(rows.sparkSession, "fine", {
        "ema": "string", "rs_horizon": "string", "rs_population_slice": "string", "distance_bucket": "string"})
    return dense(cells, stats, conf.outcome_horizons).select(
        "ema", "rs_horizon", "rs_population_slice", "outcome_horizon", "distance_bucket", "n", *METRIC_COLS
    )


def pullback_ranges() -> list[tuple[str, float, float, bool]]:
    label, lo, hi = cfg.PULLBACK_REFERENCE_RANGE
    grid = [
        (f"{a:+d}% to {b:+d}%", float(a), float(b), False)
        for a in cfg.PULLBACK_GRID_LO for b in cfg.PULLBACK_GRID_HI
    ]
    return [(label, lo, hi, True)] + grid


def range_comparison(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """What each candidate distance range (bounds included) would have held, RS >= 90, one horizon."""
    h = conf.pullback_horizon
    pushes = {p: f"{stem}_{h}d" for p, stem in PUSHES.items()}
    mids = {
        "median_mfe_pct": (f"mfe_pct_{h}d", 0.5),
        "median_mae_pct": (f"mae_pct_{h}d", 0.5),
        "median_forward_return": (f"forward_return_close_{h}d", 0.5),
    }
    strong = strong_rows(rows, [*pushes.values(), *[c for c, _ in mids.values()]], conf)
    space = CellSpace()
    space.add("all", {}, _strong_dims(conf))
    for label, lo, hi, is_ref in pullback_ranges():
        space.add("range", {"range_label": label, "range_lo": lo, "range_hi": hi, "is_v1_reference": is_ref},
                  _strong_dims(conf), where=F.col("dist").between(lo, hi))
    coded = code_rows(strong, {"cell_id": space.ids()}, [c for c, _ in mids.values()], keep=pushes.values())
    # Ranges overlap: rows between two neighbouring range ends are in the same ranges, and are counted once together.
    sums = coded.totals(
        n=F.lit(1), **{f"hits_{p}": flag(F.col(c) == 1.0) for p, c in pushes.items()},
        **{f"sum_{p}": F.col(c) for p, c in pushes.items()}, **{f"n_{p}": F.col(c).isNotNull().cast("long") for p, c in pushes.items()},
    )
    sums = sums.withColumns({f"share_{p}": F.try_divide(f"sum_{p}", f"n_{p}") for p in pushes})
    cells = space.frame(
        rows.sparkSession, "range",
        {"ema": "string", "rs_horizon": "string", "range_label": "string", "range_lo": "double",
         "range_hi": "double", "is_v1_reference": "boolean"},
        {"all_id": lambda r: space.id_of("all", ema=r["ema"], rs_horizon=r["rs_horizon"])},
    )
    totals = F.broadcast(sums.select(  # one row per cell of the space
        F.col("cell_id").alias("all_id"), *[F.col(f"hits_{p}").alias(f"total_{p}") for p in pushes]
    ))
    out = (
        cells.join(sums, "cell_id", "left").join(wide_quantiles(coded, mids), "cell_id", "left")
        .join(totals, "all_id", "left")
    )
    cols = ["ema", "rs_horizon", "range_label", "range_lo", "range_hi", "is_v1_reference",
            F.coalesce("n", F.lit(0)).alias("n_in_range")]
    for p in pushes:
        total = F.coalesce(F.col(f"total_{p}"), F.lit(0.0))
        hits = F.coalesce(F.col(f"hits_{p}"), F.lit(0.0))
        cols += [
            total.cast("long").alias(f"n_successful_{p}_total"),
            F.when(total > 0, F.round(F.lit(100.0) * hits / total, 2)).alias(f"share_of_successful_{p}_in_range"),
            F.col(f"share_{p}").alias(f"{p}_share_in_range"),
        ]
    return out.select(*cols, *mids)


def extended_among_pushes(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """Per EMA and RS horizon: successful pushes, how many of them were Extended, and the percent."""
    push = F.col(f"{PUSHES['plus5_before_minus5']}_{conf.pullback_horizon}d") == 1.0
    sums, slots = [], []
    for e in EMAS:
        for rs in conf.state_rs_horizons:
            ok = ~is_resetting(e, conf) & high_rs(rs, conf) & push
            sums += [
                F.count_if(ok).alias(f"n_{e}_{rs}"),
                F.count_if(ok & (F.col("atr_extension") >= conf.extended_at)).alias(f"x_{e}_{rs}"),
            ]
            n, x = F.col(f"n_{e}_{rs}"), F.col(f"x_{e}_{rs}")
            slots.append(F.struct(
                F.lit(f"ema{e}").alias("ema"), F.lit(rs).alias("rs_horizon"), n.alias("n_successful_pushes_10d"),
                x.alias("n_extended_among_them"), pct_of(x, n).alias("pct_extended_among_them"),
            ))
    return rows.agg(*sums).select(F.explode(F.array(*slots)).alias("s")).select("s.*")


def exclusion_counts(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> DataFrame:
    """(metric, key, value): rows excluded as Resetting, rows kept, and missing inputs."""
    watched = ("distance_ema10_pct", "distance_ema20_pct", "atr_extension", *conf.state_rs_horizons)
    sums = rows.agg(
        *[F.count_if(is_resetting(e, conf)).alias(f"out_{e}") for e in EMAS],
        *[F.count_if(~is_resetting(e, conf)).alias(f"in_{e}") for e in EMAS],
        *[F.count_if(F.col(c).isNull()).alias(f"miss_{c}") for c in watched],
    )
    slots = []
    for e in EMAS:
        slots += [("n_resetting_excluded", f"ema{e}", f"out_{e}"), ("n_remaining", f"ema{e}", f"in_{e}")]
    slots += [("missing_values", c, f"miss_{c}") for c in watched]
    arr = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(k).alias("key"), F.col(c).cast("double").alias("value"))
        for m, k, c in slots
    ])
    return sums.select(F.explode(arr).alias("s")).select("s.*")


def pullback_study(rows: DataFrame, conf: StudyConfig = DEFAULT.study) -> dict[str, DataFrame]:
    return {
        "push_distance_distribution": push_distribution(rows, conf),
        "push_distance_buckets": distance_buckets(rows, conf),
        "ema_pullback_candidate_comparison": range_comparison(rows, conf),
    }
