"""

Every query starts from the raw tables in the given folder. The panel tables several
studies share (panel, ranked features, study rows) are staged once per session and folder,
as a user would build them once and then run studies on them; `forget()` drops that.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from datetime import date

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from barlattice import config as cfg  # noqa: E402
from barlattice.config import DEFAULT, EngineConfig, IndexConfig  # noqa: E402
from barlattice.operators import breadth, classify, history, index_health, outcomes, quality, technical, universe  # noqa: E402
from barlattice.operators.cells import small_cells  # noqa: E402
from barlattice.plans import panel as P  # noqa: E402
from barlattice.plans import studies as S  # noqa: E402
from barlattice.plans.jobs import Engine, breadth_sanity, index_sanity  # noqa: E402
from barlattice.schemas import FEATURE_COLUMNS, LANDED_REFERENCE, UNIVERSE_COLUMNS, conform  # noqa: E402
from barlattice.session import drop_staged, joined_by_entity, stage, stage_root, tune  # noqa: E402
from barlattice.sources import derived, landing  # noqa: E402
from barlattice.sources.warehouse import Warehouse  # noqa: E402
from barlattice.streaming.ingest import ingest_stream  # noqa: E402
from oracles.queries import CORRECTED_OUTCOMES, ORACLES, SMALL_SAMPLE_TABLES  # noqa: E402

try:  # the corpus operators are an optional subpackage; this is the only place that does without it
    import corpus_pipeline
    from barlattice.llm import registry as corpus_registry
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "barlattice.llm"):
        raise
    corpus_pipeline = corpus_registry = None

YEAR = 2000
# Memberships of the derived index are small at tiny scale; the real minimum is the default.
INDEX = IndexConfig(min_components=2)

_shared: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Drop the shared staged tables, files included, so that the next query starts from the raw tables."""
    for df in _shared.values():
        drop_staged(df)
    _shared.clear()
    _engines.clear()
    _tables.clear()


class Frames:
    """The derived panel of one folder, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = tune(spark), sf_dir.rstrip("/")

    def _once(self, name: str, build: Callable[[], DataFrame], *part: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf, name, *part)
        if key not in _shared:
            _shared[key] = build()
        return _shared[key]

    def raw(self) -> DataFrame:
        """The landed bars as traded: derived from the order lines once, then read as a table."""
        return self._once("raw", lambda: stage(derived.weekly_bars(self.spark, self.sf), "raw"))

    def bars(self) -> DataFrame:
        """Adjusted bars with the close as traded beside them."""
        return derived.scaled(self.raw().withColumn("close_unadjusted", F.col("close")))

    def unadjusted(self) -> DataFrame:
        return self.raw().select("date", "ticker", F.col("close").alias("close_unadjusted"))

    def snapshots(self) -> DataFrame:
        return derived.reference_snapshots(self.spark, self.sf)

    def shares(self) -> DataFrame:
        return derived.monthly_shares(self.spark, self.sf)

    def _panel(self, outcomes: bool = True, history: bool = False, kept: Callable[[DataFrame], DataFrame] = lambda panel: panel) -> DataFrame:
        """The panel, or what `kept` keeps of it, staged: rows and columns that a query has no use for are never written."""
        with joined_by_entity(self.spark):
            return stage(kept(P.build_panel(self.bars(), self.snapshots(), self.shares(), outcomes=outcomes, history=history)), "panel")

    def panel(self) -> DataFrame:
        """All rows: gates, features without ranks, outcomes."""
        return self._once("panel", self._panel)

    def with_eligible_key(self) -> DataFrame:
        """The panel's rows whose key has an eligible row, for queries that look at no others."""
        return self._once("panel", lambda: self._panel(history=True, kept=lambda p: p.filter("key_eligible").drop(*history.HISTORY_COLUMNS)), "key_eligible")

    def slim(self) -> DataFrame:
        """The panel without outcomes, for queries that don't look ahead."""
        if (self.spark.sparkContext.applicationId, self.sf, "panel") in _shared:
            return self.panel()
        return self._once("slim", lambda: self._panel(outcomes=False))

    def universe(self) -> DataFrame:
        """Gates only."""
        def build():
            with joined_by_entity(self.spark):
                return stage(P.build_universe(self.bars(), self.snapshots(), self.shares()), "universe")

        return self._once("universe", build)

    def outcomes(self) -> DataFrame:
        return self._once("outcomes", lambda: stage(P.build_outcomes(self.bars()), "outcomes"))

    def _ranked(self, kept: DataFrame, columns, sources: dict[str, str], name: str, history_of: DataFrame | None = None) -> DataFrame:
        """Eligible rows of a staged part of the panel (whole dates) with these columns and ranks, joined to their key's history."""
        ranks = stage(P.panel_ranks(kept, sources), "ranks")  # by itself, so that its shuffles are gone when wide rows are joined
        rows = classify.eligible_only(kept).select(*KEY, "eligible", *columns).join(ranks, KEY, "left")
        if history_of is not None:
            rows = rows.join(history_of.select(*KEY, *history.HISTORY_COLUMNS), KEY)
        rows = stage(rows, name)
        drop_staged(ranks)
        return rows

    def _eligible_ranked(self, columns, sources: dict[str, str], name: str, **panel) -> DataFrame:
        kept = self._panel(kept=lambda p: classify.eligible_only(p).select(*KEY, "eligible", *dict.fromkeys([*columns, *sources.values()])), **panel)
        rows = self._ranked(kept, columns, sources, name)
        drop_staged(kept)
        return rows

    def _with_past(self, only: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of the panel, history among their columns, whose key has an eligible row; of them what `only` keeps."""
        columns = dict.fromkeys([*STUDY_COLUMNS, *history.HISTORY_COLUMNS, *cfg.RS_SOURCES.values()])
        return self._panel(history=True, kept=lambda p: only(p.filter("key_eligible")).select(*KEY, "eligible", *columns))

    def rows(self) -> DataFrame:
        """Eligible rows with RS ranks, outcomes and what else the studies read."""
        return self._once("rows", lambda: self._eligible_ranked(STUDY_COLUMNS, cfg.RS_SOURCES, "rows"))

    def thrusts(self) -> DataFrame:
        """Eligible rows with thrust ranks."""
        return self._once("thrusts", lambda: self._eligible_ranked([], cfg.THRUST_SOURCES, "thrusts", outcomes=False))

    def features(self) -> DataFrame:
        """All rows with ranks."""
        return P.with_ranks(self.slim())

    def with_history(self) -> DataFrame:
        slim = self.slim().select("date", "ticker", "eligible", "atr_extension", "distance_ema10_pct", "distance_ema20_pct")
        return history.add_prior_extension_history(slim)

    def year(self) -> DataFrame:
        """Eligible rows of the target year with RS ranks, outcomes and prior history. Ranks are of one date, so no other year's are needed."""
        def build():
            kept = self._with_past(of_year)
            rows = self._ranked(kept, STUDY_COLUMNS, cfg.RS_SOURCES, "year", history_of=kept)
            drop_staged(kept)
            return rows

        return self._once("year", build)

    def rows_and_year(self) -> None:
        """Both from one pass over the panel, for queries that read both."""
        if any((self.spark.sparkContext.applicationId, self.sf, name) in _shared for name in ("rows", "year")):
            return
        kept = self._with_past(lambda p: p)
        rows = self._once("rows", lambda: self._ranked(kept, STUDY_COLUMNS, cfg.RS_SOURCES, "rows"))
        past = of_year(kept).select(*KEY, *history.HISTORY_COLUMNS)
        self._once("year", lambda: stage(of_year(rows).join(past, KEY), "year"))
        drop_staged(kept)

    def members(self) -> DataFrame:
        def build():
            raw = self.raw()
            members = derived.index_members(raw)
            return stage(index_health.checked_members(
                raw.select("date").distinct(), members.select("index_id", "date").distinct(), members, INDEX
            ), "members")

        return self._once("members", build)

    def index_structure(self) -> DataFrame:
        return index_health.price_structure(derived.index_series(self.raw()))

    def member_breadth(self) -> DataFrame:
        panel = index_health.member_panel(
            index_health.restrict_to_members(self.bars().select("date", "ticker", "close", "high", "low"), self.members()), INDEX
        )
        return index_health.member_breadth(self.members(), panel, INDEX)

    def oscillators(self) -> DataFrame:
        return self._once("osc", lambda: stage(index_health.add_oscillators(self.member_breadth(), INDEX), "osc"))

    def health(self) -> DataFrame:
        return self.index_structure().join(self.oscillators(), ["index_id", "date"])

    def index_outcomes(self) -> DataFrame:
        return index_health.index_outcomes(self.index_structure(), INDEX)

    def breadth(self) -> DataFrame:
        return breadth.market_breadth(self.rows())


# Engines add in different orders, so doubles are rounded at the query's edge. The small
# shift keeps values that are exact decimal halves from falling either way by a last bit;
# adding 0.0 turns -0.0 into 0.0.
ROUND_SHIFT = 3.7e-8


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        (F.round(F.col(f.name) + F.lit(ROUND_SHIFT), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


KEY = ["date", "ticker"]
# What studies, breadth and sanity tables read of eligible rows, beside their key and ranks.
STUDY_COLUMNS = ["return_21d", "atr_extension", "distance_ema10_pct", "distance_ema20_pct", *outcomes.outcome_columns()]


def of_year(df: DataFrame) -> DataFrame:
    return df.filter(F.year("date") == YEAR)


def pick(df: DataFrame, *cols: str) -> DataFrame:
    return rounded(df.select(*cols))


# --- one function per query; f is the Frames of the folder -------------------------

def q_returns(f):
    return pick(technical.add_returns(f.bars()), *KEY, *cfg.RETURN_HORIZONS)


def q_true_range_atr(f):
    return pick(technical.add_atr(f.bars()), *KEY, "true_range", "atr14", "atr_pct")


def q_adr20(f):
    return pick(technical.add_adr(f.bars()), *KEY, "adr20")


def q_moving_averages(f):
    df = technical.add_moving_averages(f.bars().repartition("ticker"), co_located=True)
    return pick(df, *KEY, "ema10", "ema20", "sma50", "distance_ema10_pct", "distance_ema20_pct")


def q_sma50_slope(f):
    return pick(technical.add_sma50_slope(technical.add_sma(f.bars(), {"sma50": 50})), *KEY, "sma50_slope_pct")


def q_sma50_streak(f):
    return pick(technical.add_sma50_persistence(technical.add_sma(f.bars(), {"sma50": 50})), *KEY, "sma50_persistence_days")


def q_atr_extension(f):
    df = technical.add_atr_extension(technical.add_sma(technical.add_atr(f.bars()), {"sma50": 50}))
    return pick(df, *KEY, "gain_from_sma50_pct", "atr_extension")


def q_thrust(f):
    df = technical.add_thrust(f.bars().repartition("ticker"), co_located=True)
    return pick(df, *KEY, *cfg.THRUST_SPANS)


def q_asset_type(f):
    return universe.asset_type_ok(f.snapshots())


def q_unadjusted_join(f):
    bars = derived.scaled(f.raw()).select(*KEY, "close")
    return pick(universe.with_unadjusted_close(bars, f.unadjusted()), *KEY, "close", "close_unadjusted")


def q_market_cap(f):
    df = universe.with_shares(f.bars(), f.shares())
    return pick(df.withColumn("market_cap", F.col("close_unadjusted") * F.col("shares_outstanding")),
                *KEY, "shares_outstanding", "market_cap")


def q_universe_daily(f):
    return pick(f.universe(), *UNIVERSE_COLUMNS)


def q_universe_from_two_scans(f):
    """The same table as the job builds it, adjusted bars joined to unadjusted closes."""
    df = universe.market_universe(derived.scaled(f.raw()), f.unadjusted(), f.snapshots(), f.shares())
    return pick(df, *UNIVERSE_COLUMNS)


def q_rs_percentile(f):
    return pick(f.rows(), *KEY, *cfg.RS_SOURCES)


def q_thrust_percentile(f):
    return pick(f.thrusts(), *KEY, *cfg.THRUST_SOURCES)


def q_features_daily(f):
    return pick(f.features(), *FEATURE_COLUMNS)


def q_top_rs(f):
    """The ten strongest eligible tickers of each date over one month (rank, then ticker)."""
    w = Window.partitionBy("date").orderBy(F.col("rs_percentile_1m").desc(), "ticker")
    top = f.rows().filter(F.col("rs_percentile_1m").isNotNull()).withColumn("place", F.row_number().over(w))
    return pick(top.filter("place <= 10"), "date", "place", "ticker", "rs_percentile_1m", "return_21d")


def q_new_high(f):
    return technical.add_new_low(technical.add_new_high(f.bars())).select(*KEY, "is_new_20d_high", "is_new_20d_low")


def _outcome_query(stems):
    def run(f):
        df = outcomes.add_outcomes(technical.add_atr(f.bars()))
        return pick(df, *KEY, *[c for c in outcomes.outcome_columns() if c.startswith(stems)])

    return run


def q_first_hit_day(f):
    df = outcomes.add_first_hits(f.bars(), DEFAULT.outcomes, 20)
    return df.select(*KEY, *[F.col(f"_{s}_{t}").cast("long").alias(f"first_{s}_{t}") for s in ("up", "down") for t in ("5", "10")])


def q_outcomes_daily(f):
    return pick(f.outcomes(), *KEY, *outcomes.outcome_columns())


def q_outcomes_year(f):
    """Outcomes over a quarter and a year of rows."""
    conf = cfg.OutcomeConfig(horizons=(63, 252))
    return pick(outcomes.stock_outcomes(f.slim(), conf), *KEY, *outcomes.outcome_columns(conf))


def q_outcomes_from_features(f):
    return pick(outcomes.stock_outcomes(f.panel()), *KEY, *DEFAULT.outcomes.columns(10))


def q_prior_extension(f):
    return pick(f.with_history(), *KEY, *history.HISTORY_COLUMNS)


def q_prior_extension_year(f):
    """Peaks and minima over a year of rows in place of a quarter."""
    slim = f.slim().select(*KEY, "atr_extension", "distance_ema10_pct", "distance_ema20_pct")
    found = history.add_prior_extension_history(slim, cfg.HistoryConfig(windows=(20, 252), peak_window=252))
    return pick(
        found, *KEY, "max_atr_extension_prior_20d", "max_atr_extension_prior_252d", "n_valid_days_prior_peak_window",
        "days_since_atr_extension_peak", "atr_extension_drawdown_from_peak", "min_distance_ema10_pct_since_peak",
        "min_distance_ema20_pct_since_peak")


def q_candidate_state(f):
    df = f.with_history()
    return df.select(*KEY, *[classify.candidate_state(e).alias(f"candidate_state_ema{e}") for e in ("10", "20")])


def q_rs_breadth(f):
    return rounded(breadth.daily_rs_breadth(f.rows()))


def q_future_breadth(f):
    return pick(breadth.future_breadth(breadth.daily_rs_breadth(f.rows())), "date", *breadth.future_breadth_columns())


def q_cohort_performance(f):
    return rounded(breadth.cohort_performance(f.rows()))


def q_market_breadth(f):
    return pick(f.breadth(), "date", *breadth.cohort_columns(), *breadth.future_breadth_columns(),
                "eligible_count", *[f"breadth_rs{b}plus_share" for b in (80, 90, 95)])


def q_rs_benchmark(f):
    return rounded(S.rs_benchmark(f.rows()))


def q_rs_benchmark_common(f):
    return rounded(S.rs_benchmark_common(f.rows()))


def q_common_sample_summary(f):
    return rounded(S.common_sample_summary(f.rows()))


def _table(study, name):
    return lambda f: rounded(study(f)[name])


_tables: dict[tuple, dict[str, DataFrame]] = {}


def _study(f, name, build) -> dict[str, DataFrame]:
    """The tables of a study: views of statistics that are computed and staged once."""
    key = (f.spark.sparkContext.applicationId, f.sf, name)
    if key not in _tables:
        _tables[key] = build()
    return _tables[key]


def _atr(f):
    return _study(f, "atr", lambda: S.rs_atr_study(f.rows()))


def _opp(f):
    return _study(f, "opportunity", lambda: S.opportunity_study(f.year()))


def _states(f):
    return _study(f, "states", lambda: S.candidate_states(f.year()))


def q_rs_atr_small_cells(f):
    return small_cells(_atr(f)["cross_matrix"].select("rs_horizon", "outcome_horizon", "rs_bucket", "atr_bucket", "n"))


def q_rs_coverage(f):
    return rounded(S.coverage_rows(f.rows(), DEFAULT.study.rs_horizons))


def q_prior_extension_coverage(f):
    return rounded(S.prior_extension_coverage(f.year()))


def q_state_population(f):
    return S.state_population(f.year())


def q_push_distribution(f):
    return rounded(S.push_distribution(f.year()))


def q_push_distance_buckets(f):
    return rounded(S.distance_buckets(f.year()))


def q_pullback_ranges(f):
    return rounded(S.range_comparison(f.year()))


def q_extended_among_pushes(f):
    return rounded(S.extended_among_pushes(f.year()))


def q_pullback_exclusions(f):
    return rounded(S.exclusion_counts(f.year()))


def q_index_members(f):
    return rounded(f.members())


def q_component_counts(f):
    return index_health.component_counts(f.members())


def q_member_panel(f):
    df = index_health.member_panel(f.bars(), INDEX)
    return pick(df, *KEY, "sma5", "ema10", "sma20", "ema21", "sma50", "sma200",
                "is_new_20d_high", "is_new_20d_low", "is_advancer", "is_decliner")


_BREADTH_INT = ["component_count", "advancers", "decliners", "new_20d_highs", "new_20d_lows", "high_low_oscillator"]
_OSC = ["mco_raw", "mco_z", "mcsi_raw", "mcsi_z", "mcsi_z_sma10", "mcsi_z_minus_sma10"]
_CHG = [f"{c}_chg_{w}d" for c in index_health.CHANGE_COLUMNS for w in (1, 3, 5)]


def q_index_breadth(f):
    return pick(f.member_breadth(), "index_id", "date", *_BREADTH_INT, "rana",
                *[f"pct_above_{m}" for m in index_health.ABOVE], "high_low_pct")


def q_oscillators(f):
    return pick(f.oscillators(), "index_id", "date", *_OSC)


def q_breadth_changes(f):
    df = f.oscillators().withColumns({c: F.col(c).cast("double") for c in _CHG})
    return pick(df, "index_id", "date", *_CHG, "high_low_oscillator_5d_avg")


_IX_NUM = ["close", "high", "low", "ema10", "ema20", "sma50", "sma200", "distance_ema10_pct", "distance_ema20_pct",
           "distance_sma50_pct", "atr14", "atr_pct", "atr_extension"]
_IX_FLAG = ["ema10_above_ema20", "close_above_ema10", "close_above_ema20", "close_above_sma50", "close_above_sma200"]


def q_index_structure(f):
    return pick(f.index_structure(), "index_id", "date", *_IX_NUM, *_IX_FLAG)


def q_index_health_daily(f):
    df = f.health().withColumns({c: F.col(c).cast("double") for c in _CHG})
    return pick(df, "index_id", "date", *_IX_NUM, *_IX_FLAG, *_BREADTH_INT, "rana",
                *[f"pct_above_{m}" for m in index_health.ABOVE], "high_low_pct", *_OSC, *_CHG, "high_low_oscillator_5d_avg")


def q_index_outcomes(f):
    return rounded(f.index_outcomes())


def q_universe_quality(f):
    return rounded(quality.universe_quality(f.universe()))


def q_cap_sensitivity(f):
    return rounded(quality.cap_sensitivity(f.universe()))


def q_tie_diagnostics(f):
    return rounded(quality.tie_diagnostics(f.outcomes()))


def q_index_status(f):
    return rounded(quality.index_status(index_health.component_counts(f.members()), f.breadth()))


def _decile(column, label):
    return lambda f: rounded(quality.quantile_buckets(f.rows(), column, ["mfe_pct_10d", "mae_pct_10d"], label))


def _breadth_decile(column):
    return lambda f: rounded(breadth_sanity(f.breadth(), [column])[f"{column}_bucket"])


def _index_decile(column):
    return lambda f: rounded(index_sanity(f.health(), f.index_outcomes(), [column])[f"{column}_bucket"])


def _tidy(bars):
    """Bars with the column set of a landed day."""
    return bars.select(
        F.col("ticker").cast("string").alias("ticker"), "open", "high", "low", "close", "volume",
        F.lit(None).cast("double").alias("vwap"), F.lit(None).cast("long").alias("transactions"),
        F.lit(None).cast("long").alias("epoch_ms"), "date",
    )


def _fresh(f, name: str) -> str:
    """A new folder's path below the shared stage folder; whoever writes there creates it."""
    return f"{stage_root(f.spark)}/{name}-{uuid.uuid4().hex[:12]}"


EMPTY_DAY = date(1990, 1, 2)


def _landed(f):
    """All four sources landed as day files: every bar, every member and listing, and one day that has no rows."""
    def build():
        root = _fresh(f, "landing")
        tidy = _tidy(f.raw())
        landing.ingest_days(tidy, root, "grouped_daily")
        landing.ingest_days(tidy, root, "grouped_daily_unadjusted")
        members = derived.index_members(f.raw())
        landing.ingest_days(
            members.select(F.col("constituent_ticker").cast("string").alias("constituent_ticker"), "weight", "date"), root, "qqq_constituents")
        listed = f.snapshots().withColumn("ticker", F.col("ticker").cast("string"))
        landing.ingest_days(conform(listed, [*LANDED_REFERENCE.fieldNames(), "date"]), root, "reference_tickers")
        landing.write_empty_day(f.spark, root, "grouped_daily", EMPTY_DAY)
        return f.spark.createDataFrame([(root,)], "root string")

    return f._once("landing", build).first()["root"]


def _landed_with_gaps(f):
    """Bars with every seventh week left out (unadjusted: every fifth too), for the coverage query only."""
    def build():
        root = _fresh(f, "gaps")
        tidy = _tidy(f.raw().filter(derived.week_number() % 7 != 3))
        landing.ingest_days(tidy, root, "grouped_daily")
        landing.ingest_days(tidy.filter(derived.week_number() % 5 != 1), root, "grouped_daily_unadjusted")
        return f.spark.createDataFrame([(root,)], "root string")

    return f._once("gaps", build).first()["root"]


STOCK_SOURCES = ("grouped_daily", "grouped_daily_unadjusted", "reference_tickers")


def _land(f, root: str, source: str) -> None:
    """One source of the stock jobs: adjusted bars, bars as traded, or listings."""
    if source == "grouped_daily":
        landing.ingest_days(_tidy(derived.scaled(f.raw())), root, source)
    elif source == "grouped_daily_unadjusted":
        landing.ingest_days(_tidy(f.raw()), root, source)
    else:
        listed = f.snapshots().withColumn("ticker", F.col("ticker").cast("string"))
        landing.ingest_days(conform(listed, [*LANDED_REFERENCE.fieldNames(), "date"]), root, source)


def _engine_landed(f) -> str:
    """The files the stock jobs read."""
    root = _fresh(f, "landing")
    for source in STOCK_SOURCES:
        _land(f, root, source)
    return root


def _land_index(f, root: str) -> None:
    """The files the index jobs read: adjusted bars with the index's own among them, and the member lists."""
    own = derived.index_series(f.raw()).select(
        "date", F.col("index_id").alias("ticker"), "open", "high", "low", "close", F.lit(None).cast("double").alias("volume"))
    landing.ingest_days(_tidy(derived.scaled(f.raw())).unionByName(_tidy(own)), root, "grouped_daily")
    members = derived.index_members(f.raw())
    landing.ingest_days(
        members.select(F.col("constituent_ticker").cast("string").alias("constituent_ticker"), "weight", "date"), root, "qqq_constituents")


def _engine_over(f, root: str) -> tuple[Engine, DataFrame]:
    """The jobs over landed files, with stock tables built, and the shares they use."""
    shares = f.shares().withColumn("ticker", F.col("ticker").cast("string"))
    engine = Engine(f.spark, root, Warehouse(f.spark, _fresh(f, "warehouse")), EngineConfig(index=INDEX))
    engine.refresh(shares)
    return engine, shares


class Jobs:
    """The jobs a user runs over landed files. A table's job runs once, after landing and building only what it reads."""

    def __init__(self, f):
        self.f, self.done = f, set()
        self.warehouse, conf = Warehouse(f.spark, _fresh(f, "warehouse")), EngineConfig(index=INDEX)
        self.stock, self.index = (Engine(f.spark, _fresh(f, "landing"), self.warehouse, conf) for _ in range(2))
        self.shares = f.shares().withColumn("ticker", F.col("ticker").cast("string"))
        self.span = f.raw().agg(F.min("date"), F.max("date")).first()

    def _once(self, step: str, run: Callable) -> None:
        if step not in self.done:
            run()
            self.done.add(step)

    def landed(self, *sources: str) -> None:
        for source in sources:
            self._once(f"land {source}", lambda s=source: _land(self.f, self.stock.landed, s))

    def build(self, table: str) -> None:
        """Run the table's job, and before it those of the tables that it reads."""
        if table == "reference_tickers":
            self.landed(table)
            self._once(table, lambda: self.stock.reference_tickers(*self.span))
        elif table == "raw_manifest":
            self.landed(*STOCK_SOURCES)
            self._once(table, lambda: self.stock.raw_manifest(*self.span))
        elif table == "market_universe_daily":
            self.landed(*STOCK_SOURCES)
            self._once(table, lambda: self.stock.universe(*self.span, self.shares))
        elif table == "stock_features_daily":
            self.build("market_universe_daily")
            self._once(table, lambda: self.stock.features(*self.span))
        elif table == "stock_outcomes_daily":
            self.build("stock_features_daily")
            self._once(table, lambda: self.stock.outcomes(*self.span))
        elif table == "market_breadth_daily":
            self.build("stock_outcomes_daily")
            self._once(table, lambda: self.stock.market_breadth(*self.span))
        elif table == "qqq_health_daily":
            self._once("land index", lambda: _land_index(self.f, self.index.landed))
            self._once(table, lambda: self.index.index_health(*self.span, derived.INDEX_ID))
        elif table == "qqq_health_outcomes_daily":
            self.build("qqq_health_daily")
            self._once(table, lambda: self.index.index_outcomes(*self.span))
        else:
            raise KeyError(table)

    def read(self, table: str) -> DataFrame:
        self.build(table)
        return self.warehouse.read(table)


_engines: dict[tuple, Jobs] = {}


def _jobs(f) -> Jobs:
    key = (f.spark.sparkContext.applicationId, f.sf)
    if key not in _engines:
        _engines[key] = Jobs(f)
    return _engines[key]


def _job_table(name, *columns):
    """A table that a job has stored, as it is read back; tickers are numbers again."""
    def run(f):
        df = _jobs(f).read(name)
        df = df.withColumn("ticker", F.col("ticker").cast("long")) if "ticker" in df.columns else df
        return pick(df.withColumns({c: F.col(c).cast("double") for c in _CHG if c in df.columns}), *columns)

    return run


def q_job_quality(f):
    """Every metric of the quality report that the verify job stores."""
    jobs = _jobs(f)
    for table in ("market_breadth_daily", "qqq_health_outcomes_daily"):
        jobs.build(table)
    return rounded(jobs.stock.verify()["metrics"])


def q_job_lineage(f):
    """What the lineage of each stored table says of its range."""
    jobs, out = _jobs(f), None
    w = jobs.warehouse
    for name in ("market_universe_daily", "stock_features_daily", "stock_outcomes_daily", "qqq_health_daily"):
        jobs.build(name)
        one = w.read_lineage(name).select("table", "status", "data_start", "data_end", "source")
        out = one if out is None else out.unionByName(one)
    return out


def q_member_gaps(f):
    """The first five bar dates without a member list, and how many there are, where every ninth week's list is missing."""
    bars, members = f.raw(), derived.index_members(f.raw())
    known = members.filter(derived.week_number() % 9 != 4).select("index_id", "date").distinct()
    return index_health.first_gaps(index_health.membership_gaps(bars.select("date").distinct(), known))


def q_range_guards(f):
    """Which ranges, from the first bar of a year to the last of another, the single-year and the lookback guards take."""
    years = f.raw().groupBy(F.year("date").alias("y")).agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()  # years
    def taken(check, *span):
        try:
            return check(*span) is not None
        except ValueError:
            return False

    rows = [(a["lo"], b["hi"], taken(classify.check_single_year, a["lo"], b["hi"]), taken(classify.check_lookback, a["lo"], b["hi"]))
            for a in years for b in years if a["y"] <= b["y"]]
    return f.spark.createDataFrame(rows, "start date, end date, single_year boolean, lookback boolean")


CORRECTED = date(2000, 6, 5)


def q_corrected_day(f):
    """A day's adjusted bars are corrected after all tables were built: the years it reaches are built again, others stay."""
    root = _engine_landed(f)
    engine, shares = _engine_over(f, root)
    day = landing.scan_landed(f.spark, root, "grouped_daily", CORRECTED, CORRECTED)
    wrong = F.col("ticker").cast("long") % 3 == 0
    fixed = day.withColumns({c: F.when(wrong, F.col(c) * 1.5).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    landing.ingest_days(stage(fixed, "corrected"), root, "grouped_daily", force=True)
    engine.refresh(shares)
    numbered = lambda n: engine.warehouse.read(n).withColumn("ticker", F.col("ticker").cast("long"))
    features, outs = numbered("stock_features_daily"), numbered("stock_outcomes_daily")
    return pick(features.join(outs.select(*KEY, *CORRECTED_OUTCOMES), KEY), *FEATURE_COLUMNS, *CORRECTED_OUTCOMES)


def q_raw_manifest(f):
    return landing.raw_manifest(f.spark, _landed(f))


def q_landed_scan(f):
    df = landing.scan_bars(f.spark, _landed(f)).withColumn("ticker", F.col("ticker").cast("long"))
    return pick(df, *KEY, "open", "high", "low", "close", "volume")


def q_coverage_gaps(f):
    lo, hi = f.raw().agg(F.min("date"), F.max("date")).first()
    return landing.coverage_gaps(landing.candidate_weekdays(f.spark, lo, hi), landing.raw_manifest(f.spark, _landed_with_gaps(f)))


SCAN_FROM, SCAN_TO = date(1996, 1, 1), date(1996, 12, 31)


def q_bounded_scan(f):
    """Bars of one year, by the scan's own bounds."""
    df = landing.scan_bars(f.spark, _landed(f), SCAN_FROM, SCAN_TO).withColumn("ticker", F.col("ticker").cast("long"))
    return pick(df, *KEY, "open", "high", "low", "close", "volume")


def q_reference_scan(f):
    df = landing.scan_reference(f.spark, _landed(f), SCAN_FROM, SCAN_TO)
    return df.select("date", F.col("ticker").cast("long").alias("ticker"), "type", "primary_exchange")


def q_member_scan(f):
    df = landing.scan_members(f.spark, _landed(f), SCAN_FROM, SCAN_TO, derived.INDEX_ID)
    return rounded(df.withColumn("constituent_ticker", F.col("constituent_ticker").cast("long")))


def q_reference_scan_whole(f):
    """All landed reference days, without bounds."""
    df = landing.scan_reference(f.spark, _landed(f))
    return df.select("date", F.col("ticker").cast("long").alias("ticker"), "type", "primary_exchange")


def q_member_scan_whole(f):
    """All landed member days, without bounds."""
    df = landing.scan_members(f.spark, _landed(f), index_id=derived.INDEX_ID)
    return rounded(df.withColumn("constituent_ticker", F.col("constituent_ticker").cast("long")))


def q_shares_scan(f):
    path = _fresh(f, "shares")
    f.shares().withColumn("ticker", F.col("ticker").cast("string")).write.parquet(path)
    return rounded(landing.scan_shares(f.spark, path).withColumn("ticker", F.col("ticker").cast("long")))


def q_lineage_round_trip(f):
    """Lineage of a stored table: the range of the rows it was built from, read back (build time left out)."""
    w = Warehouse(f.spark, _fresh(f, "warehouse"))
    first, last = f.raw().agg(F.min("date"), F.max("date")).first()
    w.write_lineage("market_breadth_daily", first, last, "bars", "abc")
    w.write_lineage("qqq_health_daily", first, last, "members", "abc", error="no members")
    both = w.read_lineage("market_breadth_daily").unionByName(w.read_lineage("qqq_health_daily"))
    return both.select("table", "status", "data_start", "data_end", "source", "code_commit_hash", "error")


def q_report_round_trip(f):
    """A report's table written as Parquet and CSV, read back from the CSV."""
    w = Warehouse(f.spark, _fresh(f, "warehouse"))
    counts = f.raw().groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"))
    w.write_report("bars", {"per_ticker": counts}, f.spark.range(1))
    return f.spark.read.option("header", True).schema("ticker long, bars long").csv(f"{w.root}/reports/bars/csv/per_ticker")


def q_ranks_with_gaps(f):
    """Ranks where closes are missing: rows whose every rank source is NULL keep their place."""
    slim = f.slim().select(*KEY, "eligible", *dict.fromkeys(P.RANK_SOURCES.values()))
    gap = F.col("ticker") % 5 == 2
    holes = slim.withColumns({c: F.when(~gap, F.col(c)) for c in dict.fromkeys(P.RANK_SOURCES.values())})
    rows = P.with_ranks(stage(classify.eligible_only(holes), "holes"))
    return rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("return_21d").alias("n_known"), F.count("rs_percentile_1m").alias("n_ranked"))


def q_candidate_weekdays(f):
    lo, hi = f.raw().agg(F.min("date"), F.max("date")).first()
    return landing.candidate_weekdays(f.spark, lo, hi)


def q_time_splits(f):
    """Split of each bar, its date moved 28 years on into the range the splits cover."""
    bars = f.raw().select(F.add_months("date", 28 * 12).alias("date"), "ticker")
    last = bars.agg(F.max("date")).scalar()
    split = classify.time_split("date", last)
    return bars.groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def q_study_join(f):
    """Features inner-joined to outcomes on the key, eligible rows only, as the studies read them."""
    panel = f.with_eligible_key()
    rows = P.study_rows(P.with_ranks(panel).select(*FEATURE_COLUMNS), P.outcomes_table(panel))
    return pick(rows, *KEY, "rs_percentile_3m", "atr_extension", "mfe_pct_20d", "reached_3atr_20d")


def q_stored_year(f):
    """Features written by year and read back for one year (year directories pruned)."""
    w = Warehouse(f.spark, _fresh(f, "warehouse"))
    w.write("stock_features_daily", f.features().select(*FEATURE_COLUMNS))
    return pick(w.read("stock_features_daily", [YEAR]), *KEY, "eligible", "rs_percentile_6m", "sma50", "thrust_1m")


def q_streamed_landing(f):
    """Bars landed by the draining file stream, each day's rows in two files and one file a trigger, then run again."""
    base = _fresh(f, "stream")
    half = F.col("ticker").cast("long") % 2
    _tidy(f.raw()).withColumn("half", half).repartition(2, "half").drop("half").write.parquet(f"{base}/in")
    for _ in range(2):
        ingest_stream(f.spark, f"{base}/in", f"{base}/out", "grouped_daily", f"{base}/checkpoint", files_per_trigger=1)
    df = landing.scan_bars(f.spark, f"{base}/out").withColumn("ticker", F.col("ticker").cast("long"))
    return pick(df, *KEY, "open", "high", "low", "close", "volume")


def q_small_sample_counts(f):
    return rounded(S.small_sample_rows(S.candidate_states(f.year())))


def q_small_sample_studies(f):
    """Thin cells of the tables of all four studies."""
    f.rows_and_year()
    tables = {"cross_matrix": _atr(f)["cross_matrix"]} | _opp(f) | _states(f) | S.pullback_study(f.year())
    return rounded(S.small_sample_rows({k: tables[k] for k in SMALL_SAMPLE_TABLES}))


def q_restricted_bars(f):
    """Bars of tickers that are an index member at any time."""
    return pick(index_health.restrict_to_members(f.bars(), f.members()), *KEY, "close")


_QUERIES: dict[str, Callable[[Frames], DataFrame]] = {
    "panel_bars": lambda f: pick(derived.panel_bars(f.spark, f.sf), *KEY, "open", "high", "low", "close", "volume", "close_unadjusted"),
    "reference_snapshots": lambda f: f.snapshots(),
    "monthly_shares": lambda f: f.shares(),
    "returns": q_returns,
    "true_range_atr": q_true_range_atr,
    "adr20": q_adr20,
    "moving_averages": q_moving_averages,
    "sma50_slope": q_sma50_slope,
    "sma50_streak": q_sma50_streak,
    "atr_extension": q_atr_extension,
    "thrust": q_thrust,
    "asset_type": q_asset_type,
    "unadjusted_join": q_unadjusted_join,
    "market_cap": q_market_cap,
    "universe_daily": q_universe_daily,
    "universe_from_two_scans": q_universe_from_two_scans,
    "rs_percentile": q_rs_percentile,
    "thrust_percentile": q_thrust_percentile,
    "features_daily": q_features_daily,
    "top_rs": q_top_rs,
    "new_high_low": q_new_high,
    "forward_return": _outcome_query(("forward_return",)),
    "mfe_mae": _outcome_query(("mfe_pct", "mae_pct")),
    "atr_multiples": _outcome_query(("mfe_atr", "mae_atr")),
    "reached_flags": _outcome_query(("reached_plus_5pct", "reached_plus_10pct", "reached_2atr", "reached_3atr")),
    "new_high_within": _outcome_query(("new_20d",)),
    "race_flags": _outcome_query(("reached_plus_5_before", "reached_plus_10_before")),
    "first_hit_day": q_first_hit_day,
    "outcomes_daily": q_outcomes_daily,
    "outcomes_year": q_outcomes_year,
    "outcomes_from_features": q_outcomes_from_features,
    "study_join": q_study_join,
    "stored_year": q_stored_year,
    "prior_extension": q_prior_extension,
    "prior_extension_year": q_prior_extension_year,
    "candidate_state": q_candidate_state,
    "rs_breadth": q_rs_breadth,
    "future_breadth": q_future_breadth,
    "cohort_performance": q_cohort_performance,
    "market_breadth_daily": q_market_breadth,
    "rs_benchmark": q_rs_benchmark,
    "rs_benchmark_common": q_rs_benchmark_common,
    "common_sample_summary": q_common_sample_summary,
    "rs_x_atr": _table(_atr, "cross_matrix"),
    "rs_bucket_baseline": _table(_atr, "rs_bucket_baseline"),
    "universe_baseline": _table(_atr, "universe_baseline"),
    "rs_atr_small_cells": q_rs_atr_small_cells,
    "rs_coverage": q_rs_coverage,
    "rs_x_ema10": _table(_opp, "rs_x_ema10"),
    "rs_x_ema20": _table(_opp, "rs_x_ema20"),
    "prior_extension_x_ema10": _table(_opp, "prior_extension_x_ema10"),
    "prior_extension_x_ema20": _table(_opp, "prior_extension_x_ema20"),
    "repeat_offender_ema10": _table(_opp, "repeat_offender_ema10"),
    "repeat_offender_ema20": _table(_opp, "repeat_offender_ema20"),
    "prior_extension_coverage": q_prior_extension_coverage,
    "candidate_states_ema10": _table(_states, "candidate_states_by_rs_bucket_ema10"),
    "candidate_states_ema20": _table(_states, "candidate_states_by_rs_bucket_ema20"),
    "state_population": q_state_population,
    "small_sample_counts": q_small_sample_counts,
    "small_sample_studies": q_small_sample_studies,
    "push_distance_distribution": q_push_distribution,
    "push_distance_buckets": q_push_distance_buckets,
    "pullback_range_comparison": q_pullback_ranges,
    "extended_among_pushes": q_extended_among_pushes,
    "pullback_exclusions": q_pullback_exclusions,
    "index_members": q_index_members,
    "component_counts": q_component_counts,
    "restricted_bars": q_restricted_bars,
    "member_panel": q_member_panel,
    "index_breadth": q_index_breadth,
    "oscillators": q_oscillators,
    "breadth_changes": q_breadth_changes,
    "index_structure": q_index_structure,
    "index_health_daily": q_index_health_daily,
    "index_outcomes_daily": q_index_outcomes,
    "universe_quality": q_universe_quality,
    "cap_sensitivity": q_cap_sensitivity,
    "tie_diagnostics": q_tie_diagnostics,
    "index_status": q_index_status,
    "sanity_rs_decile": _decile("rs_percentile_1m", "rs_decile"),
    "sanity_atr_extension": _decile("atr_extension", "atr_extension"),
    "sanity_ema20_distance": _decile("distance_ema20_pct", "ema20_distance"),
    "sanity_breadth_rs80": _breadth_decile("breadth_rs80plus_share"),
    "sanity_breadth_rs90": _breadth_decile("breadth_rs90plus_share"),
    "sanity_mco_z": _index_decile("mco_z"),
    "sanity_mcsi_z": _index_decile("mcsi_z"),
    "sanity_pct_above_ema21": _index_decile("pct_above_ema21"),
    "sanity_high_low_pct": _index_decile("high_low_pct"),
    "landed_scan": q_landed_scan,
    "bounded_scan": q_bounded_scan,
    "reference_scan": q_reference_scan,
    "member_scan": q_member_scan,
    "reference_scan_whole": q_reference_scan_whole,
    "member_scan_whole": q_member_scan_whole,
    "shares_scan": q_shares_scan,
    "lineage_round_trip": q_lineage_round_trip,
    "report_round_trip": q_report_round_trip,
    "ranks_with_gaps": q_ranks_with_gaps,
    "streamed_landing": q_streamed_landing,
    "job_universe": _job_table("market_universe_daily", *UNIVERSE_COLUMNS),
    "job_features": _job_table("stock_features_daily", *FEATURE_COLUMNS),
    "job_outcomes": _job_table("stock_outcomes_daily", *KEY, *outcomes.outcome_columns()),
    "job_market_breadth": _job_table(
        "market_breadth_daily", "date", *breadth.cohort_columns(), *breadth.future_breadth_columns(),
        "eligible_count", *[f"breadth_rs{b}plus_share" for b in (80, 90, 95)]),
    "job_index_health": _job_table(
        "qqq_health_daily", "index_id", "date", *_IX_NUM, *_IX_FLAG, *_BREADTH_INT, "rana",
        *[f"pct_above_{m}" for m in index_health.ABOVE], "high_low_pct", *_OSC, *_CHG, "high_low_oscillator_5d_avg"),
    "job_index_outcomes": lambda f: rounded(_jobs(f).read("qqq_health_outcomes_daily")),
    "job_reference_tickers": _job_table("reference_tickers", *KEY, "type", "primary_exchange"),
    "job_manifest": _job_table("raw_manifest", "source", "date", "row_count"),
    "job_quality": q_job_quality,
    "job_lineage": q_job_lineage,
    "member_gaps": q_member_gaps,
    "range_guards": q_range_guards,
    "corrected_day": q_corrected_day,
    "raw_manifest": q_raw_manifest,
    "candidate_weekdays": q_candidate_weekdays,
    "coverage_gaps": q_coverage_gaps,
    "time_splits": q_time_splits,
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: strongest eligible tickers per date, from raw lines through the whole panel."""
    return q_top_rs(Frames(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda spark, sf_dir, fn=fn: fn(Frames(spark, sf_dir))) for name, fn in _QUERIES.items()}
    if corpus_registry is not None:
        out.update(corpus_registry.QUERIES, pipeline=corpus_pipeline.run)
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(ORACLES)
    if corpus_registry is not None:
        out.update(corpus_registry.ORACLES)
        if corpus_pipeline.ORACLE_SQL is not None:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
