"""Every window, threshold, bin edge and horizon used by the engine.

Plain frozen Python objects: values become literals in the plans. Nothing else
in the package repeats these numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Fixed values --------------------------------------------------------------
# Definitions of the panel's features, outcomes, bins and gates.

RETURN_HORIZONS = {
    "return_1d": 1,
    "return_5d": 5,
    "return_21d": 21,
    "return_3m": 63,
    "return_6m": 126,
    "return_12m": 252,
}

RS_SOURCES = {
    "rs_percentile_1d": "return_1d",
    "rs_percentile_1w": "return_5d",
    "rs_percentile_1m": "return_21d",
    "rs_percentile_3m": "return_3m",
    "rs_percentile_6m": "return_6m",
    "rs_percentile_12m": "return_12m",
}

THRUST_SPANS = {
    "thrust_1d": (2, 5),
    "thrust_1w": (5, 15),
    "thrust_1m": (10, 25),
}

THRUST_SOURCES = {
    "thrust_percentile_1d": "thrust_1d",
    "thrust_percentile_1w": "thrust_1w",
    "thrust_percentile_1m": "thrust_1m",
}

INCLUDED_TYPES = ("CS",)
EXCLUDED_TYPES = (
    "ETF", "ETN", "ETS", "ETV", "FUND", "PFD", "WARRANT", "RIGHT", "UNIT",
    "INDEX", "ADRC", "ADRP", "ADRW", "ADRR",
)

TIME_SPLITS = (
    ("fitting", date(2023, 1, 1), date(2024, 12, 31)),
    ("validation", date(2025, 1, 1), date(2025, 12, 31)),
    ("out_of_sample", date(2026, 1, 1), None),
)

RAW_SOURCES = (
    "grouped_daily",
    "grouped_daily_unadjusted",
    "qqq_constituents",
    "reference_tickers",
)

PROCESSED_TABLES = (
    "stock_features_daily",
    "stock_outcomes_daily",
    "qqq_health_daily",
    "qqq_health_outcomes_daily",
    "market_breadth_daily",
    "market_universe_daily",
    "reference_tickers",
    "raw_manifest",
)

PULLBACK_PERCENTILES = (2.5, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 97.5)
PULLBACK_PERCENTILE_NAMES = (
    "p2_5", "p5", "p10", "p25", "median", "p75", "p90", "p95", "p97_5",
)
PULLBACK_REFERENCE_RANGE = ("v1_dashboard_-5_to_+5", -5.0, 5.0)
PULLBACK_GRID_LO = (-8, -7, -6, -5, -4, -3, -2)
PULLBACK_GRID_HI = (2, 3, 4, 5, 6)

CANDIDATE_STATES = ("Normal", "Extended", "Resetting")
# End of fixed values -------------------------------------------------------


def threshold_label(value: float) -> str:
    """5.0 -> "5", 2.5 -> "2.5"; used inside generated column names."""
    return f"{value:g}"


@dataclass(frozen=True)
class OutcomeConfig:
    horizons: tuple[int, ...] = (5, 10, 20)
    pct_moves: tuple[float, ...] = (5.0, 10.0)
    atr_multiples: tuple[float, ...] = (2.0, 3.0)
    new_high_lookback: int = 20
    extra_races: tuple[tuple[float, float], ...] = ((10.0, 5.0),)

    def races(self) -> tuple[tuple[float, float], ...]:
        """Every (up, down) pair raced: the symmetric ones, then the extra ones."""
        for up, down in self.extra_races:
            if up not in self.pct_moves or down not in self.pct_moves:
                raise ValueError(
                    f"race pair ({up}, {down}) needs both thresholds in pct_moves {self.pct_moves}"
                )
        return tuple((th, th) for th in self.pct_moves) + self.extra_races

    @staticmethod
    def race_name(up: float, down: float, horizon: int, tie: bool = False) -> str:
        mark = "_tie" if tie else ""
        return (
            f"reached_plus_{threshold_label(up)}_before_minus_{threshold_label(down)}"
            f"{mark}_{horizon}d"
        )

    def columns(self, horizon: int) -> list[str]:
        h = f"{horizon}d"
        cols = [f"forward_return_close_{h}", f"mfe_pct_{h}", f"mae_pct_{h}"]
        cols += [f"reached_plus_{threshold_label(t)}pct_{h}" for t in self.pct_moves]
        cols += [f"mfe_atr_multiple_{h}", f"mae_atr_multiple_{h}"]
        cols += [f"reached_{threshold_label(m)}atr_{h}" for m in self.atr_multiples]
        cols += [f"new_20d_high_within_window_{h}"]
        for up, down in self.races():
            cols += [self.race_name(up, down, horizon), self.race_name(up, down, horizon, True)]
        return cols


@dataclass(frozen=True)
class UniverseConfig:
    adr_window: int = 20
    adr_min_pct: float = 4.0
    market_cap_min: float = 1_000_000_000.0
    near_band: float = 0.15
    volatile_ratio: float = 3.0
    implausible_close: float = 1_000_000.0
    exclude_otc: bool = True


@dataclass(frozen=True)
class HistoryConfig:
    windows: tuple[int, ...] = (20, 40, 60)
    peak_window: int = 60

    def __post_init__(self):
        if self.peak_window not in self.windows:
            raise ValueError("peak_window must be one of windows")


@dataclass(frozen=True)
class BreadthConfig:
    horizons: tuple[int, ...] = (5, 10, 20)
    rs_buckets: tuple[int, ...] = (80, 90, 95)
    rs_column: str = "rs_percentile_1m"


@dataclass(frozen=True)
class IndexConfig:
    min_components: int = 50
    rana_scale: float = 1000.0
    oscillator_spans: tuple[int, int] = (19, 39)
    z_window: int = 200
    z_min_rows: int = 80
    summation_seed: float = 0.0
    summation_smooth: int = 10
    high_low_lookback: int = 20
    change_windows: tuple[int, ...] = (1, 3, 5)
    horizons: tuple[int, ...] = (5, 10, 20)


@dataclass(frozen=True)
class StudyConfig:
    rs_horizons: tuple[str, ...] = tuple(RS_SOURCES)
    state_rs_horizons: tuple[str, ...] = (
        "rs_percentile_1w", "rs_percentile_1m", "rs_percentile_3m", "rs_percentile_6m",
    )
    outcome_horizons: tuple[int, ...] = (5, 10, 20)
    high_rs: float = 90.0
    small_sample: int = 30
    extended_at: float = 8.0
    reset_peak_at: float = 8.0
    reset_below: float = 4.0
    reset_distance: float = 0.0
    pullback_horizon: int = 10


@dataclass(frozen=True)
class EngineConfig:
    outcomes: OutcomeConfig = field(default_factory=OutcomeConfig)
    universe: UniverseConfig = field(default_factory=UniverseConfig)
    history: HistoryConfig = field(default_factory=HistoryConfig)
    breadth: BreadthConfig = field(default_factory=BreadthConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    study: StudyConfig = field(default_factory=StudyConfig)


DEFAULT = EngineConfig()
