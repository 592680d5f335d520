"""The feature vector of a symbol at a bar: 21 values in fixed order, each null where it is missing, with the reason.

Every series is cut at the bar's closing time: windows end at the bar, four-hour bars and settlements are taken as of its close, and cross-sections
are those of the same bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.scalars import DAY_MS, HOUR_MS, change, history_too_short, utc_hour
from . import funding as fu
from . import structure as st
from .joins import as_of
from .sliding import dry_up, mid_rank, run_below_median, sliding

VERSION = "features-v1"
#: In the order of the vector. Fixed values.
FEATURES = (
    "c1_effort_vs_result", "c2_sell_absorbed", "d1_vol_squeeze_pct", "d2_volume_dryup_pct", "d3_compression_bars", "d4_vol_squeeze_4h", "e1_rel_btc_24h", "e2_rel_median_24h", "e3_ret_rank_pct", "f1_sweep_reclaim", "f1_occurred",
    "f2_up", "f2_down", "f3_range_containment", "f1_sweep_reclaim_4h", "f1_occurred_4h", "f2_up_4h", "f2_down_4h", "g1_breadth_ema60", "g2_btc_vol_regime", "a3_funding_z",
)
H4 = 4 * HOUR_MS
WEEK = 168
#: Returns of the market's volatility, daily samples of its rank, and the bars that both need.
REGIME, SAMPLES = 720, 365
LONG = (SAMPLES - 1) * 24 + REGIME + 1
col = F.col


def with_range(bars: DataFrame, step: int) -> DataFrame:
    """``atr`` and ``atr_pct``, whether the longest window is ``whole``, and how many bars a symbol ``have``."""
    x = bars.withColumn("tr", w.true_range()).withColumn("atr", w.mean_of("tr", 14, step_ms=step)).withColumn("atr_pct", col("atr") / col("c") * 100)
    return x.withColumns({"whole": w.contiguous(col("t"), w.NEED, step), "have": F.row_number().over(w.by_time())})


def _cross_section(x: DataFrame, least: int) -> DataFrame:
    """e2 and e3: the day's return against the median of all symbols, and its mid-rank among them."""
    at = x.where("r24 is not null").groupBy("t")
    both = at.agg(F.median("r24").alias("_median"), F.count("*").alias("_coins"))
    rank = F.rank().over(Window.partitionBy("t").orderBy("r24"))
    ties = F.count("*").over(Window.partitionBy("t", "r24"))
    ranks = x.where("r24 is not null").select("symbol", "t", rank.alias("_rank"), ties.alias("_ties"))
    x = x.join(both, "t", "left").join(ranks, ["symbol", "t"], "left")
    enough = col("_coins") >= least
    e2 = F.when(enough, (col("r24") - col("_median")) / (col("atr_pct") * F.sqrt(F.lit(24.0))))
    return x.withColumns({"e2_rel_median_24h": e2, "e3_ret_rank_pct": F.when(enough, 100.0 * (col("_rank") - 1 + 0.5 * col("_ties")) / col("_coins"))})


def market_regime(market: DataFrame) -> DataFrame:
    """``t`` and g2: the rank of the market's volatility over a month among its values at the same hour of a year of days."""
    lr = F.when(col("t") - F.lag("t").over(w.by_time()) == HOUR_MS, F.log(col("c") / F.lag("c").over(w.by_time())))
    x = market.withColumn("lr", lr).withColumn("sd", F.when(w.full(col("lr"), REGIME), F.stddev_samp("lr").over(w.frame(-(REGIME - 1))))).withColumn("slot", utc_hour(col("t")))
    x = x.select("symbol", "t", "slot", (col("t") - col("slot") * HOUR_MS).alias("day"), "sd", F.row_number().over(w.by_time()).alias("market_have"), col("c").alias("mc"))
    return sliding(x, {"g2_btc_vol_regime": mid_rank("sd", SAMPLES)}, DAY_MS, ("symbol", "slot"), "day").select("t", "g2_btc_vol_regime", "market_have", "mc")


def breadth(hourly: DataFrame, least: int) -> DataFrame:
    """``t`` and g1: the share of symbols above their mean of 60 hours, of those with its whole window."""
    x = hourly.select("t", "c", w.ema("c", 60, 360, step_ms=HOUR_MS).alias("ema")).where("ema is not null")
    return x.groupBy("t").agg(F.avg(F.when(col("c") > col("ema"), 1.0).otherwise(0.0)).alias("g1_breadth_ema60"), F.count("*").alias("_n")).where(col("_n") >= least).drop("_n")


def _structure(bars: DataFrame, lookback: int, sweep: int, step: int, suffix: str) -> DataFrame:
    x = st.features(bars, lookback, sweep, step)
    d = lambda c: col(c).cast("double")
    return x.select(
        "symbol", "t", col("f1").alias(f"f1_sweep_reclaim{suffix}"), d("f1_occurred").alias(f"f1_occurred{suffix}"), d("f2_up").alias(f"f2_up{suffix}"), d("f2_down").alias(f"f2_down{suffix}"), col("f3").alias(f"f3_range_containment{suffix}"),
        col("state").alias(f"state{suffix}"), col("reason").alias(f"structure{suffix}"),
    )


def feature_vectors(hourly: DataFrame, four: DataFrame, market: DataFrame, funding: DataFrame, floor: float, least_coins: int = 50) -> DataFrame:
    """``symbol, t``, the ``FEATURES``, ``missing`` (their names in order), ``reasons`` (a map) and ``version`` for every hourly bar.

    ``hourly``, ``four`` and ``market`` are bars (``symbol, t, o, h, l, c, v, tb``), ``funding`` settlements (``symbol, time, rate``); ``floor`` is the least spread of
    funding. A cross-section needs ``least_coins`` symbols.
    """
    by = w.by_time()
    x = with_range(hourly, HOUR_MS).join(market_regime(market), "t", "left")
    day = col("t") - F.lag("t", 24).over(by) == DAY_MS
    x = x.withColumns({
        "span": F.when(col("atr") > 0, (col("h") - col("l")) / col("atr")), "ret": change(col("c"), F.lag("c").over(by)), "mret": change(col("mc"), F.lag("mc").over(by)),
        "r24": F.when(day, change(col("c"), F.lag("c", 24).over(by))), "m24": F.when(day, change(col("mc"), F.lag("mc", 24).over(by))),
        "week": w.contiguous(col("t"), WEEK + 1, HOUR_MS) & w.full(col("mc"), WEEK + 1), "short": w.contiguous(col("t"), 15, HOUR_MS), "move": F.abs(col("c") - F.lag("c").over(by)),
    })
    ranks = {f"_{c}": mid_rank(c, w.TRAIL) for c in ("v", "span", "atr_pct")} | {"_dry": dry_up("v", w.TRAIL), "_below": run_below_median("atr_pct", w.TRAIL, w.RUN)}
    x = sliding(x, ranks, HOUR_MS).withColumns({c: F.when(col("whole"), col(c)) for c in ranks})
    sold = F.when(col("v") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (col("v") - col("tb")) / col("v")))
    beta = F.least(F.lit(3.0), F.greatest(F.lit(0.0), w.slope("ret", "mret", WEEK)))
    x = x.withColumns({
        "c1_effort_vs_result": col("_v") - col("_span"), "c2_sell_absorbed": F.when(col("short") & (col("atr") > 0), sold * (1 - F.least(F.lit(1.0), col("move") / col("atr")))),
        "d1_vol_squeeze_pct": col("_atr_pct"), "d2_volume_dryup_pct": col("_dry"), "d3_compression_bars": col("_below"),
        "e1_rel_btc_24h": F.when(col("week"), (col("r24") - beta * col("m24")) / (col("atr_pct") * F.sqrt(F.lit(24.0)))),
    })
    x = _cross_section(x, least_coins).join(breadth(hourly, least_coins), "t", "left").join(_structure(hourly, WEEK, 48, HOUR_MS, ""), ["symbol", "t"], "left")
    slow = sliding(with_range(four, H4), {"_rank": mid_rank("atr_pct", w.TRAIL)}, H4)
    slow = slow.select("symbol", "t", "c", F.when(col("whole"), col("_rank")).alias("d4_vol_squeeze_4h"), col("have").alias("have_4h"), col("whole").alias("whole_4h"))
    slow = slow.join(_structure(four, 84, 24, H4, "_4h"), ["symbol", "t"]).drop("c").withColumn("closed", col("t") + H4).drop("t")
    x = as_of(x.withColumn("at", col("t") + HOUR_MS), slow, "symbol", "at", "closed", [c for c in slow.columns if c not in ("symbol", "closed")])
    z = fu.z_scores(x.select("symbol", (col("at") - 1).alias("at")), fu.normalised(funding), floor)
    x = x.join(z.select("symbol", (col("at") + 1).alias("at"), col("z").alias("a3_funding_z"), col("why").alias("_a3")), ["symbol", "at"], "left")
    why = _reasons(least_coins)
    missing = F.filter(F.array(*(F.when(_absent(c), c) for c in FEATURES)), lambda v: v.isNotNull())
    reasons = F.map_from_entries(F.filter(F.array(*(F.when(_absent(c), F.struct(F.lit(c).alias("key"), why[c].alias("value"))) for c in FEATURES)), lambda e: e.isNotNull()))
    return x.select("symbol", "t", *(w.finite(col(c)).alias(c) for c in FEATURES), missing.alias("missing"), reasons.alias("reasons"), F.lit(VERSION).alias("version"))


def _absent(c: str) -> Column:
    return w.finite(col(c)).isNull()


def _reasons(least_coins: int) -> dict[str, Column]:
    """Why each feature is missing, where it is: too few bars before a gap before what it depends on."""

    def windowed(need: int, gap: Column, step: int = HOUR_MS, have: str = "have", other: str = "value missing in the window") -> Column:
        n = F.coalesce(col(have), F.lit(0))
        return F.when(n < need, history_too_short(n, F.lit(need), step)).when(~F.coalesce(gap, F.lit(False)), "bars missing between the first and the last of the window").otherwise(other)

    whole, coins = windowed(w.NEED, col("whole")), f"fewer than {least_coins} coins at this time"
    out = {c: whole for c in ("c1_effort_vs_result", "d1_vol_squeeze_pct", "d2_volume_dryup_pct", "d3_compression_bars")}
    out |= {"c2_sell_absorbed": windowed(15, col("short")), "d4_vol_squeeze_4h": windowed(w.NEED, col("whole_4h"), H4, "have_4h"), "e1_rel_btc_24h": windowed(WEEK + 1, col("week"), other="benchmark missing in the window")}
    out |= {c: windowed(25, col("r24").isNotNull(), other=coins) for c in ("e2_rel_median_24h", "e3_ret_rank_pct")}
    for s in ("", "_4h"):
        blocked = F.coalesce(F.when(col(f"state{s}") == "unavailable", col(f"structure{s}")), F.when(col(f"state{s}").isNull(), F.lit("no bars of this step")))
        out |= {f"{c}{s}": F.coalesce(blocked, F.lit("range unavailable")) for c in ("f1_sweep_reclaim", "f1_occurred", "f3_range_containment")}
        out |= {f"{c}{s}": F.coalesce(blocked, F.lit("too few confirmed swings")) for c in ("f2_up", "f2_down")}
    out |= {"g1_breadth_ema60": F.lit(f"fewer than {least_coins} coins with a whole mean"), "g2_btc_vol_regime": windowed(LONG, F.lit(True), have="market_have"), "a3_funding_z": F.coalesce(col("_a3"), F.lit("no settlements of this symbol"))}
    return out
