"""The jobs a user runs: each reads landed days or stored tables, builds, and stores."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..operators import breadth, index_health, quality
from ..operators.classify import check_lookback, check_single_year, eligible_only
from ..operators.outcomes import stock_outcomes
from ..operators.universe import with_unadjusted_close
from ..session import drop_staged, joined_by_entity, stage
from ..sources import landing
from ..sources.warehouse import Warehouse
from . import refresh as R
from . import studies
from .panel import build_features, build_universe, features_table, panel_ranks, panel_state, study_rows, year_rows


@dataclass
class Engine:
    """Landed files under `landed`, processed tables and reports under `warehouse`."""

    spark: SparkSession
    landed: str
    warehouse: Warehouse
    conf: EngineConfig = DEFAULT
    commit: str = "unknown"

    def _store(self, table: str, df: DataFrame, start: date, end: date, source: str, years=None, laid_out: bool = False) -> DataFrame:
        """Write the table; its lineage records the range of the stored rows (the asked one if there are none).

        A build of some years extends the recorded range; both come from what was observed in the writes.
        """
        seen, before = self.warehouse.write(table, df, years=years, laid_out=laid_out), None
        if years is not None and (lineage := self.warehouse.read_lineage(table)) is not None:
            before = lineage.filter("status = 'available'").select("data_start", "data_end").first()
        first, last = seen["first"] or start, seen["last"] or end
        if before is not None:
            first, last = min(first, date.fromisoformat(before["data_start"])), max(last, date.fromisoformat(before["data_end"]))
        self.warehouse.write_lineage(table, first, last, source, self.commit)
        self.warehouse.write_missing(table, seen)
        return self.warehouse.read(table)

    def _table(self, name: str, years=None) -> DataFrame:
        df = self.warehouse.read(name, years)
        if df is None:
            raise RuntimeError(f"{name} has not been built")
        return df

    # B1 - B2
    def reference_tickers(self, start: date, end: date) -> DataFrame:
        return self._store("reference_tickers", landing.scan_reference(self.spark, self.landed, start, end),
                           start, end, "reference_tickers")

    def raw_manifest(self, start: date, end: date) -> DataFrame:
        return self._store("raw_manifest", landing.raw_manifest(self.spark, self.landed, start, end),
                           start, end, "landed files")

    # B3
    def universe(self, start: date, end: date, shares: DataFrame) -> DataFrame:
        bars = landing.scan_bars(self.spark, self.landed, start, end)
        unadjusted = landing.scan_unadjusted(self.spark, self.landed, start, end)
        for what, df in (("adjusted", bars), ("unadjusted", unadjusted)):
            if df.isEmpty():
                raise RuntimeError(f"no landed {what} bars in {start}..{end}")
        return self._store_universe(bars, unadjusted, shares, start, end)

    def _store_universe(self, bars, unadjusted, shares, start: date, end: date, years=None) -> DataFrame:
        """Bars may begin with a lookback before `start`; only rows from `start` on are stored."""
        listed = landing.scan_reference(self.spark, self.landed, start, end)
        with joined_by_entity(self.spark):  # one ticker layout for all four inputs
            laid_out = with_unadjusted_close(bars.repartition("ticker"), unadjusted.repartition("ticker").hint("merge"))
            df = build_universe(laid_out, listed, shares, self.conf).filter(F.col("date") >= F.lit(start))
            return self._store("market_universe_daily", df, start, end, "grouped_daily+reference_tickers+shares", years, laid_out=True)

    # B4
    def features(self, start: date, end: date) -> DataFrame:
        universe = self._table("market_universe_daily").filter(F.col("date").between(start, end))
        bars = landing.scan_bars(self.spark, self.landed, start, end)
        if universe.isEmpty() or bars.isEmpty():
            raise RuntimeError("features need landed bars and a built universe table")
        return self._store_features(bars, universe, start, end)

    def _store_features(self, bars, universe, start: date, end: date, first=None, state=None, years=None) -> DataFrame:
        """The table and the end state of each of its years; with `state`, rows from `first` on that continue it."""
        with joined_by_entity(self.spark):
            panel = stage(build_features(bars, universe, first=first, state=state), "features")
        ranks = stage(panel_ranks(panel), "ranks")  # by itself, so that its shuffles are gone when the wide rows are written
        with joined_by_entity(self.spark):
            df = features_table(panel, ranks)
            out = self._store("stock_features_daily", df, start, end, "grouped_daily+universe", years, laid_out=True)
        self.warehouse.write_state("feature_state", panel_state(panel), by_year=True)
        drop_staged(panel)
        drop_staged(ranks)
        return out

    # B5
    def outcomes(self, start: date, end: date) -> DataFrame:
        df = stock_outcomes(self._table("stock_features_daily"), self.conf.outcomes)
        return self._store("stock_outcomes_daily", df, start, end, "stock_features_daily", laid_out=True)

    # B6
    def market_breadth(self, start: date, end: date) -> DataFrame:
        return self._store("market_breadth_daily", self._breadth(), start, end, "stock_features_daily+stock_outcomes_daily")

    def _breadth(self, years=None) -> DataFrame:
        """Breadth looks at eligible rows only; a row without outcomes stays in its cohort."""
        eligible = eligible_only(self._table("stock_features_daily", years)).select(
            "date", "ticker", "eligible", self.conf.breadth.rs_column
        )
        outcomes = self._table("stock_outcomes_daily", years).select("date", "ticker", *breadth.cohort_inputs(self.conf.breadth))
        rows = eligible.join(outcomes, ["date", "ticker"], "left")
        return breadth.market_breadth(stage(rows, "breadth"), self.conf.breadth)

    # B3 - B6 again, for late and corrected days
    def refresh(self, shares: DataFrame) -> dict[str, list[int]]:
        """Bring the stored tables up to the landed days; the years rebuilt, by table ({} when no day has changed).

        The first run builds all. Later ones find the days whose rows differ from those of the last run and rebuild the
        years these reach (see `refresh`); files of other years are left alone. Marks of the days are kept last, so a
        run that breaks off is done again. A change of `shares` alone isn't seen.
        """
        sources = ("grouped_daily", "grouped_daily_unadjusted", "reference_tickers")
        marks = stage(landing.changed_days(self.spark, self.landed, sources, self.warehouse.read_state("day_marks")), "marks")
        first, last = marks.filter("change <> 'same'").agg(F.min("date"), F.max("date")).first()
        built = {} if first is None else self._rebuild(first, last, shares)
        self.warehouse.write_state("day_marks", marks.filter("change <> 'gone'").drop("change"))
        return built

    def _rebuild(self, first: date, last: date, shares: DataFrame) -> dict[str, list[int]]:
        back = R.lookback_rows(self.conf)
        all_bars = landing.scan_bars(self.spark, self.landed)
        keys = stage(all_bars.select("ticker", "date"), "keys")
        lo, hi = keys.agg(F.min("date"), F.max("date")).first()
        if lo is None:
            raise RuntimeError("no landed bars are left")
        breadth_table, states = self.warehouse.read("market_breadth_daily"), self.warehouse.read_state("feature_state")
        todo = R.plan(keys, breadth_table, first, last, self.conf)
        new_year, year_end = (lambda y: date(y, 1, 1)), (lambda y: date(y, 12, 31))

        def bars_of(years: range, scan=landing.scan_bars) -> DataFrame:
            """Bars of the years with the lookback of their tickers."""
            since, _ = R.reach(keys, new_year(years[0]), year_end(years[-1]), back, 0)
            bars = scan(self.spark, self.landed, since, year_end(years[-1]))
            return R.around(bars, new_year(years[0]), year_end(years[-1]), back, 0)

        years = todo.universe
        unadjusted = landing.scan_unadjusted(self.spark, self.landed, new_year(years[0]), year_end(years[-1]))
        self._store_universe(bars_of(years), unadjusted, shares, new_year(years[0]), year_end(years[-1]), years)
        built = {"market_universe_daily": list(years), "stock_features_daily": []}

        years = todo.features if states is not None else range(lo.year, todo.features[-1] + 1)  # without states, from the start
        while True:
            before = R.state_before(states, years[0])
            before = before if before is None else stage(before, "state")
            old = None if states is None else stage(states.filter(F.col("year") == years[-1]), "state")
            universe = self._table("market_universe_daily", years)
            self._store_features(bars_of(years), universe, new_year(years[0]), year_end(years[-1]), new_year(years[0]), before, years)
            built["stock_features_daily"] += list(years)
            states = self.warehouse.read_state("feature_state")
            if years[-1] >= hi.year or (old is not None and R.same_state(old, states, years[-1])):
                break
            years = range(years[-1] + 1, years[-1] + 2)

        years = todo.outcomes
        rows = self._table("stock_features_daily").select("date", "ticker", "close", "high", "low", "atr14")
        near = R.around(rows, new_year(years[0]), year_end(years[-1]), self.conf.outcomes.new_high_lookback, max(self.conf.outcomes.horizons))
        df = stock_outcomes(near, self.conf.outcomes).filter(F.year("date").between(years[0], years[-1]))
        self._store("stock_outcomes_daily", df, new_year(years[0]), year_end(years[-1]), "stock_features_daily", years, laid_out=True)
        built["stock_outcomes_daily"] = list(years)

        years = range(todo.breadth_from, built["stock_features_daily"][-1] + 1)
        df = self._breadth(range(years[0], hi.year + 1)).filter(F.year("date") <= years[-1])
        self._store("market_breadth_daily", df, new_year(years[0]), year_end(years[-1]), "stock_features_daily+stock_outcomes_daily", years)
        return built | {"market_breadth_daily": list(years)}

    # B7
    def index_health(self, start: date, end: date, index_id: str = "QQQ") -> DataFrame | None:
        """Builds the index table, or records why it is unavailable; never uses another day's members."""
        bars = landing.scan_bars(self.spark, self.landed, start, end)
        own = bars.filter(F.col("ticker") == index_id).withColumn("index_id", F.lit(index_id))
        try:
            if own.isEmpty():
                raise index_health.MembershipUnavailable(f"no bars of the index {index_id} itself")
            snaps = landing.landed_dates(self.spark, self.landed, "qqq_constituents", start, end).withColumn(
                "index_id", F.lit(index_id)
            )
            members = index_health.checked_members(
                landing.landed_dates(self.spark, self.landed, "grouped_daily", start, end), snaps,
                landing.scan_members(self.spark, self.landed, start, end, index_id), self.conf.index,
            )
        except index_health.MembershipUnavailable as why:
            self.warehouse.write_lineage("qqq_health_daily", start, end, "members", self.commit, error=str(why))
            return None
        df = index_health.index_health(members, bars, own, self.conf.index)
        return self._store("qqq_health_daily", df, start, end, "grouped_daily+qqq_constituents")

    # B8
    def index_outcomes(self, start: date, end: date) -> DataFrame:
        df = index_health.index_outcomes(self._table("qqq_health_daily"), self.conf.index, self.conf.outcomes)
        return self._store("qqq_health_outcomes_daily", df, start, end, "qqq_health_daily")

    # B9
    def verify(self) -> dict[str, DataFrame]:
        universe = self._table("market_universe_daily")
        features, outcomes = self._table("stock_features_daily"), self._table("stock_outcomes_daily")
        metrics = quality.universe_quality(universe, self.conf.universe).unionByName(
            quality.cap_sensitivity(universe, self.conf.universe)
        )
        for name, df in (("stock_feature_rows", features), ("stock_outcome_rows", outcomes)):
            metrics = metrics.unionByName(quality.as_rows(df.agg(F.count(F.lit(1)).alias("k")), {name: "k"}))
        market = self.warehouse.read("market_breadth_daily")
        health = self.warehouse.read("qqq_health_daily")
        if market is not None:
            metrics = metrics.unionByName(quality.breadth_status(market))
        if health is not None:
            metrics = metrics.unionByName(quality.component_status(health.select("index_id", "date", "component_count")))
        index_table = self.warehouse.read("qqq_health_outcomes_daily")
        metrics = metrics.unionByName(self._availability(health, index_table))
        ties = quality.tie_diagnostics(outcomes, self.conf.outcomes)
        rows = stage(study_rows(features, outcomes), "sanity")
        two = ["mfe_pct_10d", "mae_pct_10d"]
        tables = {
            "metrics": metrics,
            "tie_diagnostics": ties,
            "rs_decile": quality.quantile_buckets(rows, "rs_percentile_1m", two, "rs_decile"),
            "atr_extension_bucket": quality.quantile_buckets(rows, "atr_extension", two, "atr_extension"),
            "ema20_distance_bucket": quality.quantile_buckets(rows, "distance_ema20_pct", two, "ema20_distance"),
        }
        if market is not None:
            tables |= breadth_sanity(market)
        if health is not None and index_table is not None:
            tables |= index_sanity(health, index_table)
        self.warehouse.write_report("data_quality", tables, metrics)
        return tables

    def _availability(self, health: DataFrame | None, outcomes: DataFrame | None) -> DataFrame:
        """Rows of the index tables (0 where there is none), and 1 or 0 for whether index health is available."""
        out = None
        for name, df in (("qqq_health_rows", health), ("qqq_health_outcome_rows", outcomes)):
            counted = self.spark.range(0 if df is None else 1).agg(F.count(F.lit(1)).alias("k")) if df is None else df.agg(F.count(F.lit(1)).alias("k"))
            one = quality.as_rows(counted, {name: "k"})
            out = one if out is None else out.unionByName(one)
        flag = self.spark.range(1).select(F.lit(int(health is not None)).alias("k"))
        return out.unionByName(quality.as_rows(flag, {"qqq_health_available": "k"}))

    def index_error(self) -> str | None:
        """Why the index table could not be built, as its lineage says; None where it was."""
        if self.warehouse.read("qqq_health_daily") is not None:
            return None
        lineage = self.warehouse.read_lineage("qqq_health_daily")
        row = lineage.select("error").first() if lineage is not None else None
        return row["error"] if row else None

    # B10 - B12
    def _year(self, start: date, end: date) -> DataFrame:
        year = check_single_year(start, end)
        rows = study_rows(
            self._table("stock_features_daily", [year]), self._table("stock_outcomes_daily", [year])
        ).filter(F.col("date").between(start, end))
        return stage(rows, "study")

    def rs_benchmark(self, start: date, end: date) -> DataFrame:
        table = studies.rs_benchmark(self._year(start, end), self.conf.study)
        self.warehouse.write_report("rs_benchmark", {"rs_benchmark": table})
        return table

    def rs_benchmark_common(self, start: date, end: date) -> DataFrame:
        rows = self._year(start, end)
        table = studies.rs_benchmark_common(rows, self.conf.study)
        self.warehouse.write_report(
            "rs_benchmark_common_sample", {"rs_benchmark_common_sample": table},
            studies.common_sample_summary(rows, self.conf.study),
        )
        return table

    def rs_atr_study(self, start: date, end: date) -> dict[str, DataFrame]:
        rows = self._year(start, end)
        tables = studies.rs_atr_study(rows, self.conf.study)
        summary = studies.coverage_rows(rows, self.conf.study.rs_horizons, self.conf.study).unionByName(
            studies.small_sample_rows({"cross_matrix": tables["cross_matrix"]}, self.conf.study)
        )
        self.warehouse.write_report("rs_atr_extension_study", tables, summary)
        return tables

    # B13 - B15
    def _target_year(self, start: date, end: date) -> DataFrame:
        year = check_lookback(start, end)
        features = self._table("stock_features_daily", range(start.year, year + 1)).filter(
            F.col("date").between(start, end)
        )
        outcomes = self._table("stock_outcomes_daily", [year])
        return stage(year_rows(features, outcomes, year, self.conf), "state")

    def opportunity_study(self, start: date, end: date) -> dict[str, DataFrame]:
        rows = self._target_year(start, end)
        tables = studies.opportunity_study(rows, self.conf.study)
        summary = (
            studies.coverage_rows(rows, self.conf.study.state_rs_horizons, self.conf.study)
            .unionByName(studies.prior_extension_coverage(rows))
            .unionByName(studies.small_sample_rows(tables, self.conf.study))
        )
        self.warehouse.write_report("opportunity_state_study", tables, summary)
        return tables

    def candidate_states(self, start: date, end: date) -> dict[str, DataFrame]:
        rows = self._target_year(start, end)
        tables = studies.candidate_states(rows, self.conf.study)
        tables["state_population"] = studies.state_population(rows, self.conf.study)
        summary = studies.coverage_rows(rows, self.conf.study.state_rs_horizons, self.conf.study).unionByName(
            studies.small_sample_rows({k: v for k, v in tables.items() if k != "state_population"}, self.conf.study)
        )
        self.warehouse.write_report("opportunity_state_candidate_rules", tables, summary)
        return tables

    def pullback_study(self, start: date, end: date) -> dict[str, DataFrame]:
        rows = self._target_year(start, end)
        tables = studies.pullback_study(rows, self.conf.study)
        summary = (
            studies.coverage_rows(rows, self.conf.study.state_rs_horizons, self.conf.study)
            .unionByName(studies.exclusion_counts(rows, self.conf.study))
            .unionByName(studies.small_sample_rows(tables, self.conf.study))
        )
        tables["extended_among_successful_pushes"] = studies.extended_among_pushes(rows, self.conf.study)
        self.warehouse.write_report("ema_pullback_range_study", tables, summary)
        return tables


BREADTH_SERIES = ("breadth_rs80plus_share", "breadth_rs90plus_share")
INDEX_SERIES = ("mco_z", "mcsi_z", "pct_above_ema21", "high_low_pct")


def breadth_sanity(market: DataFrame, series=BREADTH_SERIES) -> dict[str, DataFrame]:
    """Deciles of the same-day RS breadth against the cohort's own later performance."""
    outs = ["median_forward_return_10d", "median_mfe_pct_10d", "median_mae_pct_10d", "share_positive_10d"]
    rows = stage(market.select(*series, *outs), "sanity")
    return {f"{c}_bucket": quality.quantile_buckets(rows, c, outs, c) for c in series}


def index_sanity(health: DataFrame, outcomes: DataFrame, series=INDEX_SERIES) -> dict[str, DataFrame]:
    """Deciles of the index health series against the index's later outcomes."""
    outs = ["qqq_forward_return_10d", "qqq_mfe_pct_10d", "qqq_mae_pct_10d", "qqq_max_drawdown_pct_10d"]
    rows = stage(
        health.select("index_id", "date", *series).join(outcomes.select("index_id", "date", *outs), ["index_id", "date"]),
        "sanity",
    )
    return {f"{c}_bucket": quality.quantile_buckets(rows, c, outs, c) for c in series}
