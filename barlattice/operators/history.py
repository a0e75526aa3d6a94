"""What the entity's own past says about its extension: prior maxima, peak, touches since.

Every frame ends at the previous row, so a value never sees its own row except the two
"since the peak" minima, which run from the row after the peak through the current one.
Peak windows of up to SHORT rows use plain offset columns, longer ones frames built by doubling; both give the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, HistoryConfig
from ..functions.extremes import add_doubled, extreme_since, levels_for, past_extreme
from ..functions.windows import TICKER, Axis
from ..schemas import require_columns

SHORT = 60


def _peak_by_offsets(df: DataFrame, w: int, axis: Axis) -> DataFrame:
    """Adds the peak (`_best.v`), rows since it (`_ago`) and the smallest distances since (`_since10`, `_since20`)."""
    out = df.withColumns({
        "_best": F.max("_entry").over(axis.past(w)),
        # The last `w` rows' distances as plain columns (bounded), see `outcomes.add_leads`.
        **{f"_d{e}_{k}": axis.offset(f"distance_ema{e}_pct", -k) for e in (10, 20) for k in range(1, w)},
    }).withColumn("_ago", F.col("_pos") + F.col("_best.p"))

    def since(e: int):
        """Smallest distance over the rows after the peak, the current one included."""
        terms = [f"distance_ema{e}_pct"] + [f"_d{e}_{k}" for k in range(1, w)]
        return F.expr(f"least({', '.join(f'CASE WHEN _ago > {k} THEN {t} END' for k, t in enumerate(terms))})")

    out = out.withColumns({f"_since{e}": since(e) for e in (10, 20)})
    return out.drop(*[f"_d{e}_{k}" for e in (10, 20) for k in range(1, w)])


def _peak_by_doubling(df: DataFrame, w: int, axis: Axis) -> DataFrame:
    """The same columns for a window of any length. A row carries, beside its extension, the smallest distances of the 1, 2, 4, ..
    rows after it; the row that is the peak hands them to the rows that look back at it."""
    levels = levels_for(w)
    names = [f"_m{e}_{k}" for e in (10, 20) for k in range(levels)]
    out = add_doubled(df, {f"_m{e}": (f"distance_ema{e}_pct", "least") for e in (10, 20)}, levels, axis)
    after = [axis.offset(x, 1 << int(x.rsplit("_", 1)[1])).alias(x) for x in names]
    carried = F.when(F.col("_entry").isNotNull(), F.struct("_entry.v", "_entry.p", *after))
    out = add_doubled(out.withColumn("_carried", carried), {"_peak": ("_carried", "greatest")}, levels, axis)
    out = out.withColumn("_best", past_extreme("_peak", "greatest", w, axis)).drop("_carried", *[f"_peak_{k}" for k in range(levels)])
    out = out.withColumn("_ago", F.col("_pos") + F.col("_best.p"))
    out = out.withColumns({f"_since{e}": extreme_since("_ago", f"_m{e}", f"_best._m{e}_{{}}", "least", levels) for e in (10, 20)})
    return out.drop(*names)


def add_prior_extension_history(
    df: DataFrame, conf: HistoryConfig = DEFAULT.history, axis: Axis = TICKER
) -> DataFrame:
    require_columns(
        df, [axis.key, axis.time, "atr_extension", "distance_ema10_pct", "distance_ema20_pct"],
        "prior-extension input",
    )
    w = conf.peak_window
    ext = F.col("atr_extension")
    # The earliest of equal maxima: larger extension first, then smaller position.
    entry = F.when(ext.isNotNull(), F.struct(ext.alias("v"), (-F.col("_pos")).alias("p")))
    out = df.withColumn("_pos", F.row_number().over(axis.rows())).withColumn("_entry", entry)
    out = out.withColumns({
        **{f"max_atr_extension_prior_{n}d": F.max(ext).over(axis.past(n)) for n in conf.windows},
        "n_valid_days_prior_peak_window": F.count(ext).over(axis.past(w)),
    })
    out = (_peak_by_offsets if w <= SHORT else _peak_by_doubling)(out, w, axis)
    out = out.withColumns({
        "atr_extension_peak": F.col("_best.v"),
        "days_since_atr_extension_peak": F.col("_ago").cast("double"),
        "atr_extension_drawdown_from_peak": ext - F.col("_best.v"),
        "min_distance_ema10_pct_since_peak": F.col("_since10"),
        "min_distance_ema20_pct_since_peak": F.col("_since20"),
    })
    out = out.withColumns({
        f"touched_ema{n}_since_peak": (F.col(f"min_distance_ema{n}_pct_since_peak") <= 0).cast("double")
        for n in (10, 20)
    })
    return out.drop("_pos", "_entry", "_best", "_ago", "_since10", "_since20")


HISTORY_COLUMNS = (
    [f"max_atr_extension_prior_{n}d" for n in DEFAULT.history.windows]
    + [
        "atr_extension_peak", "n_valid_days_prior_peak_window", "days_since_atr_extension_peak",
        "atr_extension_drawdown_from_peak", "min_distance_ema10_pct_since_peak",
        "min_distance_ema20_pct_since_peak", "touched_ema10_since_peak", "touched_ema20_since_peak",
    ]
)
