"""Periods of series that are cut into nights: one free constant a night, and errors from nights drawn anew.

A night's nine weighted sums at a frequency, less what its own constant takes, add up over nights to the sums of the joint fit
with one column a night, exactly. So everything is one pass over the rows: the night's sums are rows of a table, a fit adds
them, and a bootstrap adds them with multiplicities. Draws are hashes of (series, replicate, draw), the same on any cluster.
Rows with NULL or NaN are left out, as are weights that are not positive; NULL keys make a group of their own; empty tables give
empty ones. The grid is a stated list of frequencies, which each row meets.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import col, finite, safe_div
from seriesforge.operators.robust import quantiles
from seriesforge.operators.series import refine_peak
from seriesforge.sources.tables import checkpointed, join_on

#: Draws of a bootstrap that a task makes on average.
DRAWS = 1 << 17

SUMS = ("yy", "yc", "ys", "cc", "cs", "ss")


def night_sums(df: DataFrame, keys: list[str], night: str, t, y, w, low: float, high: float, n: int) -> DataFrame:
    """keys, night, k, rows, and the six sums of products of y, cos and sin less their weighted means in the night."""
    step = (high - low) / max(1, n - 1)
    weight = F.lit(1.0) if w is None else finite(w)
    base = df.select(*keys, night, finite(t).alias("_t"), finite(y).alias("_y"), weight.alias("_w")).where("_t IS NOT NULL AND _y IS NOT NULL AND _w > 0")
    a = 2 * math.pi * (F.lit(low) + F.col("k") * step) * F.col("_t")
    at = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select("*", F.cos(a).alias("_c"), F.sin(a).alias("_s"))
    one = {"y": F.col("_y"), "c": F.col("_c"), "s": F.col("_s")}
    sums = [F.sum(F.col("_w") * one[p]).alias(f"_{p}1") for p in one] + [F.sum(F.col("_w") * one[p[0]] * one[p[1]]).alias(f"_{p}2") for p in SUMS]
    found = at.groupBy(*keys, night, "k").agg(F.count(F.lit(1)).alias("rows"), F.sum("_w").alias("_W"), *sums)
    return found.select(*keys, night, "k", "rows", *[(F.col(f"_{p}2") - F.col(f"_{p[0]}1") * F.col(f"_{p[1]}1") / F.col("_W")).alias(p) for p in SUMS])


def power_of(sums: DataFrame, keys: list[str], low: float, high: float, n: int, times: Column | None = None) -> DataFrame:
    """keys, k, f, power, amplitude of the sums of nights, each taken `times` times: the share of chi square that the sinusoid takes beyond the
    nights' constants, and its amplitude. NULL for fewer than five rows or a singular fit."""
    times = F.lit(1) if times is None else times
    step = (high - low) / max(1, n - 1)
    total = sums.groupBy(*keys, "k").agg(F.sum(times * F.col("rows")).alias("_n"), *[F.sum(times * F.col(p)).alias(p) for p in SUMS])
    yy, yc, ys, cc, cs, ss = (F.col(p) for p in SUMS)
    # A frequency whose sinusoid is constant within each night leaves rounding only.
    det = F.when((F.col("_n") >= 5) & (cc * ss - cs * cs > 1e-12 * (cc + ss) * (cc + ss)), cc * ss - cs * cs)
    a, b = (yc * ss - ys * cs) / det, (ys * cc - yc * cs) / det
    power = F.least(F.greatest(safe_div(a * yc + b * ys, yy), F.lit(0.0)), F.lit(1.0))
    return total.select(*keys, "k", (F.lit(low) + F.col("k") * step).alias("f"), power.alias("power"), F.hypot(a, b).alias("amplitude"))


def multiplicities(nights: DataFrame, keys: list[str], night: str, replicates: int, seed: int = 0) -> DataFrame:
    """keys, night, rep, times: how often each night is drawn in each replicate, as many draws as the key has nights. nights has one row for each."""
    numbered = nights.select(*keys, night, (F.row_number().over(Window.partitionBy(*keys).orderBy(night)) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    # A small table makes many draws: tasks by their number, not by the table's bytes.
    numbered = checkpointed(numbered)
    numbered = numbered.repartition(max(1, math.ceil(numbered.count() * replicates / DRAWS)), *keys, "_i")
    # Each night's row makes one draw of each replicate: its own number is the draw's.
    name = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col("rep").cast("string"), F.col("_i").cast("string"))
    hashed = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    drawn = numbered.select(*keys, "_n", "_i", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).select(*keys, "rep", F.pmod(hashed, F.col("_n")).alias("_i"))
    times = drawn.groupBy(*keys, "rep", "_i").agg(F.count(F.lit(1)).alias("times"))
    return join_on(times, numbered.select(*keys, "_i", night), [*keys, "_i"]).select(*keys, night, "rep", "times")


def bootstrapped_period(sums: DataFrame, keys: list[str], night: str, low: float, high: float, n: int, replicates: int, least_nights: int = 3) -> DataFrame:
    """keys, replicates, period (median), sigma of the highest peak between low and high over replicates of nights. sums is stored; no row of the
    series is read again. NULLs for fewer than `least_nights` nights."""
    nights = sums.select(*keys, night).distinct()
    drawn = join_on(sums, multiplicities(nights, keys, night, replicates), [*keys, night])
    grid = power_of(drawn, [*keys, "rep"], low, high, n, F.col("times")).where("power IS NOT NULL")
    peaks = refine_peak(grid, [*keys, "rep"], (high - low) / max(1, n - 1)).withColumn("_p", safe_div(F.lit(1.0), F.col("f")))
    spread = peaks.groupBy(*keys).agg(F.count("_p").alias("replicates"), F.stddev_samp("_p").alias("sigma"))
    middle = quantiles(peaks, keys, "_p", [0.5]).select(*keys, F.col("q")[0].alias("period"))
    enough = nights.groupBy(*keys).agg((F.count(F.lit(1)) >= least_nights).alias("_ok"))
    out = join_on(join_on(enough, spread, keys, "left"), middle, keys, "left")
    return out.select(*keys, F.coalesce("replicates", F.lit(0)).alias("replicates"), F.when(F.col("_ok"), F.col("period")).alias("period"), F.when(F.col("_ok"), F.col("sigma")).alias("sigma"))


def bootstrapped_ratio(df: DataFrame, keys: list[str], unit: str, top, bottom, replicates: int, least_units: int = 12) -> DataFrame:
    """keys, units, ratio, sigma of sum(top) / sum(bottom) with whole units (stars, nights) drawn anew: with top = w z r and bottom = w z z it is
    the error of a one-parameter fit whose rows are not independent within a unit. NULL sigma for fewer than `least_units`."""
    sums = df.select(*keys, unit, finite(top).alias("_a"), finite(bottom).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL").groupBy(*keys, unit).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    # Read three times below; written, the rows are summed once.
    sums = checkpointed(sums)
    ratio = safe_div(F.sum("_a"), F.sum("_b"))
    drawn = join_on(sums, multiplicities(sums.select(*keys, unit), keys, unit, replicates), [*keys, unit])
    again = drawn.groupBy(*keys, "rep").agg(safe_div(F.sum(F.col("times") * F.col("_a")), F.sum(F.col("times") * F.col("_b"))).alias("_r"))
    whole = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), ratio.alias("ratio"))
    spread = again.groupBy(*keys).agg(F.stddev_samp("_r").alias("sigma"))
    return join_on(whole, spread, keys).select(*keys, "units", "ratio", F.when(F.col("units") >= least_units, F.col("sigma")).alias("sigma"))


def bootstrapped_threshold(df: DataFrame, keys: list[str], night: str, x: str, replicates: int, bins: int = 64) -> DataFrame:
    """keys, replicates, threshold (mean), sigma of the split of a histogram with the greatest variance between both sides, over replicates of
    nights. The bins are of the whole series; a replicate adds the nights' counts. Of equally good splits the middle one counts."""
    v = finite(x)
    rows = df.select(*keys, night, v.alias("_v")).where("_v IS NOT NULL")
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_hi > _lo")
    at = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    counts = join_on(rows, span, keys).groupBy(*keys, night, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    drawn = join_on(counts, multiplicities(rows.select(*keys, night).distinct(), keys, night, replicates), [*keys, night])
    hist = drawn.groupBy(*keys, "rep", "bin").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    upto, whole = Window.partitionBy(*keys, "rep").orderBy("bin"), Window.partitionBy(*keys, "rep")
    sums = hist.select("*", F.sum("n").over(upto).alias("_w0"), F.sum("n").over(whole).alias("_w"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("_s0"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("_s"), F.lead("bin").over(upto).alias("_next"))
    w1 = F.col("_w") - F.col("_w0")
    # The bin numbers are whole, so equal splits have equal scores.
    gap = F.col("_s0") * w1 - (F.col("_s") - F.col("_s0")) * F.col("_w0")
    scored = sums.where(F.col("_w0") < F.col("_w")).withColumn("_score", F.round(gap.cast("double") * gap / (F.col("_w0") * w1), 6))
    # Between two filled bins every cut is as good: its middle.
    cut = F.col("_lo") + ((F.col("bin") + F.col("_next") + 1) / 2) * (F.col("_hi") - F.col("_lo")) / bins
    best = scored.groupBy(*keys, "rep").agg(F.max(F.struct("_score", (-F.col("bin")).alias("b"), cut.alias("cut"))).alias("m"))
    return best.groupBy(*keys).agg(F.count(F.lit(1)).alias("replicates"), F.avg("m.cut").alias("threshold"), F.stddev_samp("m.cut").alias("sigma"))


def alias_fractions(df: DataFrame, keys: list[str], t, offset: float = 1.0, orders: tuple[int, ...] = (-3, -2, -1, 1, 2, 3)) -> DataFrame:
    """keys, order, fraction: height of the sampling's window at multiples of an offset, how tall a sidelobe an alias makes."""
    rows = df.select(*keys, finite(t).alias("_t")).where("_t IS NOT NULL").select("*", F.explode(F.array(*[F.lit(o) for o in orders])).alias("order"))
    a = 2 * math.pi * offset * F.col("order") * F.col("_t")
    c, s = F.avg(F.cos(a)), F.avg(F.sin(a))
    return rows.groupBy(*keys, "order").agg((c * c + s * s).alias("fraction"))


def half_widths(grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f, half_width of the highest peak of a power grid (keys, k, f, power): half of the span of the neighbouring frequencies whose power is
    half of it or more."""
    top = grid.groupBy(*keys).agg(F.max(F.struct("power", (-F.col("k")).alias("_b"), F.col("f").alias("_f"), F.col("k").alias("_k"))).alias("m"))
    met = join_on(grid, top, keys)
    low = F.col("power") < F.col("m.power") / 2
    edges = met.groupBy(*keys, "m").agg(F.max(F.when(low & (F.col("k") < F.col("m._k")), F.col("k"))).alias("_l"), F.min(F.when(low & (F.col("k") > F.col("m._k")), F.col("k"))).alias("_r"), F.min("k").alias("_k0"), F.max("k").alias("_k1"), F.min("f").alias("_f0"), F.max("f").alias("_f1"))
    left, right = F.coalesce(F.col("_l") + 1, F.col("_k0")), F.coalesce(F.col("_r") - 1, F.col("_k1"))
    step = safe_div(F.col("_f1") - F.col("_f0"), F.col("_k1") - F.col("_k0"))
    return edges.select(*keys, F.col("m._f").alias("f"), ((right - left) * step / 2).alias("half_width"))
