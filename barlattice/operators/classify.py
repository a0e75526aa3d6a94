"""Row classification: candidate states, cohorts, slices, sample masks, time splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..config import DEFAULT, StudyConfig
from ..functions.scalar import c, held


def state_ordinal(ema: str, conf: StudyConfig = DEFAULT.study) -> Column:
    """0 Normal, 1 Extended, 2 Resetting; NULL without a current extension.

    Extended wins. Resetting needs a high prior peak, a low current extension and the
    close at or below the chosen EMA; any missing part makes that test False.
    """
    if ema not in ("10", "20"):
        raise ValueError(f"ema must be '10' or '20', got {ema!r}")
    ext = F.col("atr_extension")
    resetting = (
        (F.col("atr_extension_peak") >= conf.reset_peak_at)
        & (ext < conf.reset_below)
        & (F.col(f"distance_ema{ema}_pct") <= conf.reset_distance)
    )
    return F.when(ext.isNotNull(), F.when(ext >= conf.extended_at, 1).when(held(resetting), 2).otherwise(0))


def candidate_state(ema: str, conf: StudyConfig = DEFAULT.study) -> Column:
    names = F.array(*[F.lit(s) for s in cfg.CANDIDATE_STATES])
    return F.get(names, state_ordinal(ema, conf))


def is_resetting(ema: str, conf: StudyConfig = DEFAULT.study) -> Column:
    """Never NULL: a row without a state is not Resetting and stays in the study."""
    return held(state_ordinal(ema, conf) == 2)


def high_rs(rs: str, conf: StudyConfig = DEFAULT.study) -> Column:
    return held(F.col(rs) >= conf.high_rs)


def common_sample(columns=tuple(cfg.RS_SOURCES)) -> Column:
    """All listed percentiles present at once."""
    return reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in columns])


def eligible_only(df: DataFrame) -> DataFrame:
    return df.filter(held(F.col("eligible")))


def time_split(day="date", last_day: Column | None = None) -> Column:
    """Name of the split a date falls in; the open-ended one runs to `last_day`."""
    day = c(day)
    out = None
    for name, start, end in cfg.TIME_SPLITS:
        stop = F.lit(end) if end is not None else last_day
        cond = day >= F.lit(start) if stop is None else day.between(F.lit(start), stop)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def in_fitting_window(day="date") -> Column:
    """Rows from the first split on; earlier ones only warm up the windows."""
    return c(day) >= F.lit(cfg.TIME_SPLITS[0][1])


def refuse_later_years(df: DataFrame, year: int) -> None:
    """Raise when the input reaches beyond the target year (reads one column's maximum)."""
    latest = df.agg(F.max(F.year("date")).alias("y")).first()["y"]
    if latest is not None and latest > year:
        raise ValueError(f"input contains rows after {year}; this study covers {year} only")


def check_lookback(start, end, year: int | None = None) -> int:
    """The range must end in the target year and start before it; gives the target year."""
    if start.year >= end.year:
        raise ValueError(f"range {start}..{end} leaves no lookback year before {end.year}")
    if year is not None and end.year != year:
        raise ValueError(f"range ends in {end.year}, target year is {year}")
    return end.year


def check_single_year(start, end) -> int:
    if start.year != end.year:
        raise ValueError(f"range {start}..{end} must stay inside one year")
    return start.year
