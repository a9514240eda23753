"""Operators on ordered series: sessions, cadence, running statistics, noise ladders, periods, episodes."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import safe_div
from seriesforge.operators.robust import in_ranges, median, neighbour, numbered, quantiles, running_sum
from seriesforge.sources.tables import checkpointed, join_on


def sessions(df: DataFrame, keys: list[str], t: str, gap: float, tie: str) -> DataFrame:
    """df with block: a new one begins where the gap to the row before is over `gap` (numeric time)."""
    rows = neighbour(in_ranges(df, keys, [t, tie]), keys, [t, tie], [t], "_before")
    new = F.coalesce((F.col(t) - F.col(f"_before.{t}") > gap).cast("int"), F.lit(0))
    return running_sum(rows, keys, [t, tie], new, "block").drop("_before", "_part")


def block_stats(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys, block, n, start, stop, span of rows that have a block."""
    return df.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("start"), F.max(t).alias("stop"), (F.max(t) - F.min(t)).alias("span"))


def longest_run(df: DataFrame, keys: list[str], t: str, gap: float, tie: str) -> DataFrame:
    """keys, n, start, stop of the block with most rows, the earlier one of equals."""
    blocks = block_stats(sessions(df, keys, t, gap, tie), keys, t)
    best = blocks.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("block")).alias("b"), "start", "stop")).alias("m"))
    return best.select(*keys, F.col("m.n").alias("n"), F.col("m.start").alias("start"), F.col("m.stop").alias("stop"))


def cadence(df: DataFrame, keys: list[str], t: str, tie: str, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """keys, n, baseline, median_gap (of positive gaps), in_band (share of gaps between low and high medians)."""
    gaps = neighbour(in_ranges(df.select(*keys, t, tie), keys, [t, tie]), keys, [t, tie], [t], "_before").select(*keys, t, (F.col(t) - F.col(f"_before.{t}")).alias("gap"))
    first = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(t) - F.min(t)).alias("baseline"))
    positive = gaps.where("gap > 0")
    middle = quantiles(positive, keys, "gap", [0.5]).select(*keys, F.col("q")[0].alias("median_gap"))
    ok = F.col("gap").between(low * F.col("median_gap"), high * F.col("median_gap"))
    band = join_on(positive, middle, keys).groupBy(*keys, "median_gap").agg(F.avg(ok.cast("double")).alias("in_band"))
    return join_on(first, band, keys, "left").select(*keys, "n", "baseline", "median_gap", "in_band")


def running_median(df: DataFrame, keys: list[str], t: str, tie: str, x: str, half: int, out: str = "running") -> DataFrame:
    """Centred median over `half` rows to either side, fewer at the ends."""
    w = Window.partitionBy(*keys).orderBy(t, tie).rowsBetween(-half, half)
    return df.withColumn(out, F.percentile(F.col(x).cast("double"), F.lit(0.5)).over(w))


def running_median_range(df: DataFrame, keys: list[str], t: str, x: str, width: float, out: str = "running") -> DataFrame:
    """Centred median over a window of time; t and width in seconds, both ends included."""
    half = round(width * 500_000)
    w = Window.partitionBy(*keys).orderBy(F.round(F.col(t) * 1_000_000).cast("long")).rangeBetween(-half, half)
    return df.withColumn(out, F.percentile(F.col(x).cast("double"), F.lit(0.5)).over(w))


def relative_veto(df: DataFrame, x: str, running: str, threshold: float) -> DataFrame:
    """ratio to the running median, and veto where it is below the threshold; without a median there is no veto."""
    r = safe_div(F.col(x), F.col(running))
    return df.withColumn("ratio", r).withColumn("veto", F.coalesce(r < threshold, F.lit(False)))


def without_block_means(df: DataFrame, keys: list[str], x: str, out: str = "residual") -> DataFrame:
    """x less its group's mean, by an aggregate and a join."""
    means = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.count(x).alias("_n"))
    return join_on(df, means, keys).withColumn(out, F.when(F.col("_n") >= 2, F.col(x) - F.col("_m"))).drop("_m", "_n")


def rate_of_change(df: DataFrame, keys: list[str], t: str, tie: str, x: str, out: str = "rate") -> DataFrame:
    """Absolute second-order gradient for uneven steps; one-sided at the ends."""
    order = [t, tie]
    rows = neighbour(neighbour(in_ranges(df, keys, order), keys, order, [t, x], "_b"), keys, order, [t, x], "_f", 1)
    hb, hf = F.col(t) - F.col(f"_b.{t}"), F.col(f"_f.{t}") - F.col(t)
    xb, xf, x0 = F.col(f"_b.{x}"), F.col(f"_f.{x}"), F.col(x)
    inner = safe_div(hb * hb * xf + (hf * hf - hb * hb) * x0 - hf * hf * xb, hb * hf * (hb + hf))
    one = F.coalesce(safe_div(xf - x0, hf), safe_div(x0 - xb, hb))
    return rows.withColumn(out, F.abs(F.when(hb.isNotNull() & hf.isNotNull(), inner).otherwise(one))).drop("_b", "_f", "_part")


def cyclic_shift(df: DataFrame, keys: list[str], t: str, tie: str, x: str, by: int, out: str = "rolled") -> DataFrame:
    """x moved by `by` places around each group's ring."""
    placed = checkpointed(numbered(df, keys, [t, tie]))
    moved = placed.select(*keys, F.pmod(F.col("_i") + by, F.col("_n")).alias("_i"), F.col(x).alias(out))
    return join_on(placed, moved, [*keys, "_i"]).drop("_i", "_n")


def allan_ladder(df: DataFrame, keys: list[str], t: str, tie: str, x: str, rungs: list[int], least: int = 4) -> DataFrame:
    """keys, m, bins, deviation: non-overlapping bins of m values, root of half the mean squared step between full neighbouring bins."""
    placed = numbered(df.select(*keys, t, tie, F.col(x).cast("double").alias("_x")), keys, [t, tie])
    exploded = placed.withColumn("m", F.explode(F.array(*[F.lit(m) for m in rungs]))).withColumn("bin", F.floor(F.col("_i") / F.col("m")))
    means = checkpointed(exploded.groupBy(*keys, "m", "bin").agg(F.avg("_x").alias("mean"), F.count("_x").alias("n")).where("n = m").select(*keys, "m", "bin", "mean"))
    # A bin meets the full one before it; a bin that is not full is between no two.
    full = means.groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("bins"))
    ranged = in_ranges(means, [*keys, "m"], ["bin"])
    steps = neighbour(ranged, [*keys, "m"], ["bin"], ["mean"], "_b").withColumn("d", F.col("mean") - F.col("_b.mean"))
    spread = steps.groupBy(*keys, "m").agg(F.sqrt(F.avg(F.col("d") * F.col("d")) / 2).alias("deviation"))
    return join_on(full, spread, [*keys, "m"]).select(*keys, "m", "bins", "deviation").where(F.col("bins") >= least)


def structure_function(df: DataFrame, keys: list[str], t: str, x: str, edges: list[float], least: int = 10) -> DataFrame:
    """keys, lag_bin, pairs, sf: root of half the mean squared difference of pairs by their distance in time.

    Pairs are met by cells as wide as the longest lag, so a row meets only rows within it.
    """
    longest = edges[-1]
    own = df.select(*keys, F.col(t).alias("_t"), F.col(x).alias("_x"), F.floor(F.col(t) / longest).alias("_c"))
    a = own.withColumn("_c", F.explode(F.array(F.col("_c"), F.col("_c") + 1))).withColumnsRenamed({"_t": "_t1", "_x": "_x1"})
    # Each row is met from its own cell and from the one before it.
    pairs = a.join(own, [*keys, "_c"]).withColumn("lag", F.col("_t") - F.col("_t1")).where((F.col("lag") > 0) & (F.col("lag") < longest))
    bins = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:])))):
        bins = F.when((F.col("lag") >= lo) & (F.col("lag") < hi), i).otherwise(bins)
    d = F.col("_x") - F.col("_x1")
    out = pairs.withColumn("lag_bin", bins).where("lag_bin is not null").groupBy(*keys, "lag_bin").agg(F.count(F.lit(1)).alias("pairs"), F.sqrt(F.avg(d * d) / 2).alias("sf"))
    return out.where(F.col("pairs") >= least)


def episodes(df: DataFrame, keys: list[str], t: str, tie: str, x: str, is_state: Column, max_gap: float) -> DataFrame:
    """keys, start, stop, n, peak, peak_at: islands of rows in the state whose gaps are at most max_gap."""
    inside = df.where(is_state)
    blocked = sessions(inside, keys, t, max_gap, tie)
    return blocked.groupBy(*keys, "block").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count(F.lit(1)).alias("n"), F.max(x).alias("peak"), F.max_by(t, F.struct(F.col(x), -F.col(tie))).alias("peak_at")).drop("block")


def frequency_grid(spark, low: float, high: float, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("k"), (F.lit(low) + F.col("id") * ((high - low) / max(1, n - 1))).alias("f"))


def spectral_window(df: DataFrame, keys: list[str], t: str, low: float, high: float, n: int) -> DataFrame:
    """keys, k, f, power: |sum exp(-2 pi i f t)|^2 / N^2 on a grid. The grid is a stated bounded set that each row meets; sums combine before the shuffle."""
    step = (high - low) / max(1, n - 1)
    grid = F.sequence(F.lit(0), F.lit(n - 1))
    a = 2 * math.pi * (F.lit(low) + F.col("k") * step) * F.col(t)
    sums = df.select(*keys, F.col(t), F.explode(grid).alias("k")).groupBy(*keys, "k").agg(F.sum(F.cos(a)).alias("c"), F.sum(F.sin(a)).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select(*keys, "k", (F.lit(low) + F.col("k") * step).alias("f"), ((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / (F.col("n") * F.col("n"))).alias("power"))


def periodogram(df: DataFrame, keys: list[str], t: str, y: str, w: Column | None, low: float, high: float, n: int) -> DataFrame:
    """keys, k, f, power: floating-mean least squares power from nine sums for each frequency; no Python."""
    w = F.lit(1.0) if w is None else w
    step = (high - low) / max(1, n - 1)
    base = df.select(*keys, F.col(t).alias("_t"), F.col(y).cast("double").alias("_y"), w.alias("_w")).where("_y is not null and _w is not null")
    a = 2 * math.pi * (F.lit(low) + F.col("k") * step) * F.col("_t")
    c, s = F.cos(a), F.sin(a)
    m = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select("*", c.alias("c"), s.alias("s")).groupBy(*keys, "k").agg(
        F.sum("_w").alias("W"),
        *[F.sum(F.col("_w") * e).alias(name) for name, e in {"Y": F.col("_y"), "C": F.col("c"), "S": F.col("s"), "YY": F.col("_y") * F.col("_y"), "YC": F.col("_y") * F.col("c"), "YS": F.col("_y") * F.col("s"), "CC": F.col("c") * F.col("c"), "CS": F.col("c") * F.col("s")}.items()],
    )
    W = F.col("W")
    Y, C, S = F.col("Y") / W, F.col("C") / W, F.col("S") / W
    yy, yc, ys = F.col("YY") / W - Y * Y, F.col("YC") / W - Y * C, F.col("YS") / W - Y * S
    cc, cs, ss = F.col("CC") / W - C * C, F.col("CS") / W - C * S, (1 - F.col("CC") / W) - S * S
    d = cc * ss - cs * cs
    power = safe_div(ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys, yy * d)
    return m.select(*keys, "k", (F.lit(low) + F.col("k") * step).alias("f"), power.alias("power"))


def refine_peak(grid: DataFrame, keys: list[str], step: float) -> DataFrame:
    """keys, f, power of the highest point, moved to the vertex of the parabola through it and its neighbours."""
    best = grid.groupBy(*keys).agg(F.max_by("k", F.struct("power", -F.col("k"))).alias("_k"))
    near = join_on(grid, best, keys).where(F.abs(F.col("k") - F.col("_k")) <= 1)
    at = lambda d, c="power": F.max(F.when(F.col("k") == F.col("_k") + d, F.col(c)))
    three = near.groupBy(*keys).agg(at(-1).alias("l"), at(0).alias("m"), at(1).alias("r"), at(0, "f").alias("f0"))
    bend = F.col("l") - 2 * F.col("m") + F.col("r")
    move = F.coalesce(F.when(bend < 0, 0.5 * (F.col("l") - F.col("r")) / bend), F.lit(0.0))
    return three.select(*keys, (F.col("f0") + move * step).alias("f"), F.col("m").alias("power"))


def dispersion_theta(df: DataFrame, keys: list[str], t: str, y: str, freqs: list[float], bins: int = 10) -> DataFrame:
    """keys, f, theta: pooled variance within phase bins over the whole variance, for a stated list of frequencies."""
    base = df.select(*keys, F.col(t).alias("_t"), F.col(y).cast("double").alias("_y")).where("_y is not null")
    x = F.col("_t") * F.col("f")
    binned = base.select("*", F.explode(F.array(*[F.lit(f) for f in freqs])).alias("f")).withColumn("bin", F.floor((x - F.floor(x)) * bins)).groupBy(*keys, "f", "bin").agg(F.count("_y").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    m = F.count(F.lit(1))
    return binned.groupBy(*keys, "f").agg(safe_div(F.when(n > m, within / (n - m)), (q - s * s / n) / (n - 1)).alias("theta"))


def duty_cycle(df: DataFrame, keys: list[str], on: Column, known: Column) -> DataFrame:
    """keys, naive share of rows that are on, and the share among rows whose state is known."""
    return df.groupBy(*keys).agg(F.avg(F.coalesce(on, F.lit(False)).cast("double")).alias("naive"), F.avg(F.when(known, on.cast("double"))).alias("aware"))


def two_way_residual(df: DataFrame, row: str, column: str, x: str, sweeps: int = 3) -> DataFrame:
    """x less row and column means, taken in turns. Each sweep is two aggregates joined back; plans stay short for few sweeps."""
    out = df.withColumn("residual", F.col(x).cast("double"))
    for _ in range(sweeps):
        for k in (row, column):
            means = out.groupBy(k).agg(F.avg("residual").alias("_m"))
            out = join_on(out, means, [k]).withColumn("residual", F.col("residual") - F.col("_m")).drop("_m")
    return out
