"""Exact statistics as aggregate expressions, and the few that need a second pass over groups."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import MAD_TO_SIGMA, col, finite, safe_div
from seriesforge.sources.tables import checkpointed, join_on

Z95 = 1.959963984540054
#: Rows of a group that one task may sort.
SMALL_GROUP = 1 << 17


def median(x) -> Column:
    return F.percentile(col(x).cast("double"), F.lit(0.5))


def percentile_amplitude(x, low: float = 0.05, high: float = 0.95, least: int = 5) -> Column:
    """Spread between two percentiles; NULL for fewer than `least` values."""
    x = col(x).cast("double")
    return F.when(F.count(x) >= least, F.percentile(x, F.lit(high)) - F.percentile(x, F.lit(low)))


def rms(x) -> Column:
    return F.sqrt(F.avg(col(x) * col(x)))


def weighted_mean(x, sigma) -> Column:
    w = 1 / (col(sigma) * col(sigma))
    return safe_div(F.sum(w * col(x)), F.sum(w))


def weighted_mean_error(sigma) -> Column:
    return F.sqrt(safe_div(F.lit(1.0), F.sum(1 / (col(sigma) * col(sigma)))))


def wilson(k, n, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a proportion, from counts."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p, d = k / n, 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    mid = (p + z * z / (2 * n)) / d
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))), F.when(n > 0, F.least(mid + half, F.lit(1.0)))


def wilson_verdict(k, n, go: float, caution: float) -> Column:
    low = wilson(k, n)[0]
    return F.when(low >= go, "GO").when(low >= caution, "CAUTION").otherwise("NO-GO")


def two_proportion_z(k1, n1, k2, n2) -> Column:
    k1, n1, k2, n2 = (col(x).cast("double") for x in (k1, n1, k2, n2))
    p = (k1 + k2) / (n1 + n2)
    return safe_div(k1 / n1 - k2 / n2, F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)))


def line_fit(x, y, w=None) -> dict[str, Column]:
    """Slope, intercept and slope error of a weighted line, as closed-form sums."""
    x, y = col(x).cast("double"), col(y).cast("double")
    w = F.lit(1.0) if w is None else col(w).cast("double")
    ok = x.isNotNull() & y.isNotNull() & w.isNotNull()
    s = lambda e: F.sum(F.when(ok, e))
    sw, sx, sy, sxx, sxy = s(w), s(w * x), s(w * y), s(w * x * x), s(w * x * y)
    det = sw * sxx - sx * sx
    slope = safe_div(sw * sxy - sx * sy, det)
    return {"slope": slope, "intercept": safe_div(sxx * sy - sx * sxy, det), "slope_error": F.sqrt(safe_div(sw, det))}


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with _part: ranges of (keys, order) that may split a group, so that windows within (_part, keys) never hold a whole hot group. Written, as the
    ranges of a second evaluation could differ. What lies before a range comes from tables with one row for each range of a group."""
    return checkpointed(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def running_sum(ranged: DataFrame, keys: list[str], order: list[str], x: Column, out: str, own: bool = True) -> DataFrame:
    """in_ranges() rows with the sum of x up to each row of its group (`own`: with the row itself). `order` must tell the rows of a group apart."""
    rows = ranged.withColumn("_r_x", x)
    before = F.coalesce(F.sum("_r_s").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy("_part", *keys).agg(F.sum("_r_x").alias("_r_s")).select("_part", *keys, before.alias("_r_before"))
    inner = F.coalesce(F.sum("_r_x").over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)), F.lit(0))
    return join_on(rows.withColumn("_r_in", inner), totals, ["_part", *keys]).withColumn(out, F.col("_r_in") + F.col("_r_before")).drop("_r_x", "_r_in", "_r_before")


def neighbour(ranged: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str, by: int = -1) -> DataFrame:
    """in_ranges() rows with the struct `out` of the columns of the row before (by = -1) or after (by = 1) in its group; NULL at its ends. Rows at the
    ends of a range take theirs from the nearest range of the group."""
    value = F.struct(*columns)
    pick, reach = (F.max_by, F.lag) if by < 0 else (F.min_by, F.lead)
    ends = ranged.groupBy("_part", *keys).agg(pick(value, F.struct(*order)).alias("_r_e"))
    ends = ends.select("_part", *keys, reach("_r_e").over(Window.partitionBy(*keys).orderBy("_part")).alias("_r_e"))
    near = reach(value).over(Window.partitionBy("_part", *keys).orderBy(*order))
    return join_on(ranged.withColumn("_r_near", near), ends, ["_part", *keys]).withColumn(out, F.coalesce("_r_near", "_r_e")).drop("_r_near", "_r_e")


def numbered(df: DataFrame, keys: list[str], order: list[str], at: str = "_i", of: str = "_n") -> DataFrame:
    """df with each row's place in its group (from 0) and the group's size, by ranges. `order` must tell the rows of a group apart."""
    ranged = in_ranges(df, keys, order)
    sizes = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias(of))
    return join_on(running_sum(ranged, keys, order, F.lit(1), at, own=False), sizes, keys).drop("_part")


def interpolated(shares: list[float], low: Column, high: Column) -> Column:
    """Array of quantiles of a group whose rows are (_q_v, n) and hold the places low to high."""

    def value(share: float) -> Column:
        at = (F.col("n") - 1) * F.lit(share)
        first, last = (F.max(F.when(i.between(low, high), F.col("_q_v"))) for i in (F.floor(at), F.ceil(at)))
        return first + (F.max(at) - F.floor(F.max(at))) * (last - first)

    return F.array(*[value(s) for s in shares])


def quantiles(df: DataFrame, keys: list[str], x: str, shares: list[float], small: bool = False) -> DataFrame:
    """keys, n, q (array): exact quantiles, interpolated as percentile does, of any number of values in any group.

    Equal values are counted first; the distinct ones are ranked in ranges that may split a group, so no task holds a group's
    values. A range's ranks start after the totals of the ranges before it, of which a group has no more than there are
    partitions; only the ranges that hold a wanted rank are ranked. Groups without values have no row. `small`: the caller knows
    that no group has more than SMALL_GROUP rows; then each group is sorted as it is.
    """
    values = df.select(*keys, finite(x).alias("_q_v")).where("_q_v IS NOT NULL")
    if small:
        placed = values.select("*", (F.row_number().over(Window.partitionBy(*keys).orderBy("_q_v")) - 1).alias("_q_i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
        return placed.groupBy(*keys).agg(F.max("n").alias("n"), interpolated(shares, F.col("_q_i"), F.col("_q_i")).alias("q"))
    counts = values.groupBy(*keys, "_q_v").agg(F.count(F.lit(1)).alias("_q_t"))
    # Written once, as the ranges of a second evaluation could differ.
    ranged = checkpointed(counts.repartitionByRange(*keys, "_q_v").withColumn("_q_part", F.spark_partition_id()))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_q_s").over(whole.orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy("_q_part", *keys).agg(F.sum("_q_t").alias("_q_s")).select("_q_part", *keys, "_q_s", before.alias("_q_before"), F.sum("_q_s").over(whole).alias("n"))
    wanted = F.lit(False)
    for share in shares:
        at = (F.col("n") - 1) * F.lit(share)
        wanted = wanted | ((F.ceil(at) >= F.col("_q_before")) & (F.floor(at) < F.col("_q_before") + F.col("_q_s")))
    met = join_on(ranged, checkpointed(totals.where(wanted).drop("_q_s")), ["_q_part", *keys])
    below = F.coalesce(F.sum("_q_t").over(Window.partitionBy("_q_part", *keys).orderBy("_q_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = met.withColumn("_q_lo", below + F.col("_q_before")).withColumn("_q_hi", F.col("_q_lo") + F.col("_q_t") - 1)
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), interpolated(shares, F.col("_q_lo"), F.col("_q_hi")).alias("q"))


def median_and_mad(df: DataFrame, keys: list[str], x: str, small: bool = False) -> DataFrame:
    """keys, n, median, mad_sigma: 1.4826 times the median distance from the median; NULL for one value. Groups without values have no row.

    The groups' medians are a written table that comes back by a join: the planner knows its size and sends it to the rows.
    """
    first = checkpointed(quantiles(df, keys, x, [0.5], small).select(*keys, F.col("q")[0].alias("median")))
    away = join_on(df.select(*keys, finite(x).alias("_q_x")), first, keys).select(*keys, F.abs(F.col("_q_x") - F.col("median")).alias("_q_d"))
    spread = quantiles(away, keys, "_q_d", [0.5], small).select(*keys, "n", F.col("q")[0].alias("_q"))
    return join_on(first, spread, keys).select(*keys, "n", "median", F.when(F.col("n") >= 2, MAD_TO_SIGMA * F.col("_q")).alias("mad_sigma"))


def clipped_stats(df: DataFrame, keys: list[str], x: str, nsigma: float = 4.0) -> DataFrame:
    """keys, n, n_kept, mean, sd over the values within nsigma robust sigmas of their group's median."""
    stats = checkpointed(median_and_mad(df, keys, x).withColumnRenamed("n", "_n"))
    joined = join_on(df, stats, keys)
    keep = F.abs(F.col(x) - F.col("median")) <= nsigma * F.col("mad_sigma")
    return joined.groupBy(*keys).agg(F.count(x).alias("n"), F.count_if(keep).alias("n_kept"), F.avg(F.when(keep, F.col(x))).alias("mean"), F.stddev_samp(F.when(keep, F.col(x))).alias("sd"))


def binned_median(df: DataFrame, keys: list[str], x: str, y: str, width: float) -> DataFrame:
    """Median of y in bins of x of fixed width that begin at a multiple of it."""
    binned = quantiles(df.withColumn("bin", F.floor(F.col(x) / width)), [*keys, "bin"], y, [0.5])
    return binned.select(*keys, "bin", "n", F.col("q")[0].alias("median"))


def edge_bin(x, edges: list[float]) -> Column:
    """Number of the right-open interval between edges; NULL outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        out = F.when((col(x) >= a) & (col(x) < b), i).otherwise(out)
    return out


def pooled_tail_median(df: DataFrame, x: str, y: str, edges: list[float], least: int) -> DataFrame:
    """Medians by edges; bins from the first sparse one of the tail on are pooled and their median taken anew."""
    binned = df.withColumn("bin", edge_bin(x, edges)).where("bin is not null")
    sizes = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    full = sizes.where(F.col("n") >= least).agg(F.max("bin").alias("last"))  # one row
    last = full.first()["last"]
    return quantiles(binned.withColumn("bin", F.least("bin", F.lit(0 if last is None else last + 1))), ["bin"], y, [0.5]).select("bin", "n", F.col("q")[0].alias("median"))


def mann_whitney(df: DataFrame, x: str, is_first: Column) -> DataFrame:
    """u, n1, n2, z with mid-ranks and tie correction. Ranks come from counts of distinct values, not from a sort of all rows in one task.

    Distinct values are ranked in ranges: each range is summed by itself, and the ranges' totals (a bounded
    number) are summed up before them.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("v")).agg(F.count_if(is_first).alias("a"), F.count(F.lit(1)).alias("t"))
    # Written once, as the ranges of a second evaluation could differ.
    ranged = checkpointed(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    inner = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(F.sum("t").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(outer), F.lit(0))).drop("s")
    ranked = ranged.withColumn("below", F.coalesce(F.sum("t").over(inner), F.lit(0))).join(before, "part")
    rank = F.col("below") + F.col("before") + (F.col("t") + 1) / 2
    sums = ranked.agg(F.sum(rank * F.col("a")).alias("r1"), F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return sums.select("n1", "n2", u.alias("u"), safe_div(u - n1 * n2 / 2, sigma).alias("z"))


def kaplan_meier(df: DataFrame, keys: list[str], t: str, event: Column) -> DataFrame:
    """keys, t, at_risk, events, survival: product-limit estimate with ties; censored rows only leave the risk set."""
    steps = df.groupBy(*keys, t).agg(F.count_if(event).alias("events"), F.count(F.lit(1)).alias("leaving"))
    w = Window.partitionBy(*keys).orderBy(t)
    later = w.rowsBetween(0, Window.unboundedFollowing)
    risk = steps.withColumn("at_risk", F.sum("leaving").over(later))
    factor = 1 - F.col("events") / F.col("at_risk")
    dead = F.max((factor <= 0).cast("int")).over(w)
    log = F.sum(F.when(factor > 0, F.log(factor)).otherwise(0.0)).over(w)
    return risk.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.exp(log))).select(*keys, t, "at_risk", "events", "survival")


def survival_median(steps: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys, median: of kaplan_meier's rows the first time at which half or less are left; NULL where it is never reached."""
    return steps.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 0.5, F.col(t))).alias("median"))


def phase_coverage(phase, bins: int) -> Column:
    """Share of the phase bins with a row."""
    return F.countDistinct(F.floor(col(phase) * bins)) / bins


def otsu(df: DataFrame, keys: list[str], x: str, bins: int = 64) -> DataFrame:
    """keys, threshold: the split of a histogram of equal bins with the greatest variance between both sides.

    Rows become bin counts first; what is sorted afterwards is at most `bins` rows for each key.
    """
    span = df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    joined = join_on(df, span, keys).where("hi > lo")
    hist = joined.withColumn("bin", F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    every = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    w, whole = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    h = hist.withColumn("mid", every).withColumn("w0", F.sum("n").over(w)).withColumn("s0", F.sum(F.col("n") * F.col("mid")).over(w)).withColumn("nn", F.sum("n").over(whole)).withColumn("ss", F.sum(F.col("n") * F.col("mid")).over(whole))
    w1 = F.col("nn") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("ss") - F.col("s0")) / w1
    scored = h.where(w1 > 0).withColumn("score", F.round(F.col("w0") * w1 * gap * gap, 6)).withColumn("edge", F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins)
    return scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("bin")).alias("b"), "edge")).alias("m")).select(*keys, F.col("m.edge").alias("threshold"))


def value_histogram(df: DataFrame, keys: list[str], x: str, width: float) -> DataFrame:
    """An additive histogram: histograms of parts are merged by summing their counts."""
    return df.groupBy(*keys, F.floor(F.col(x) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def circular_mean(phase) -> tuple[Column, Column]:
    """Mean in [0, 1) and spread of phases in cycles."""
    a = 2 * math.pi * col(phase)
    s, c = F.avg(F.sin(a)), F.avg(F.cos(a))
    return F.pmod(F.atan2(s, c) / (2 * math.pi), F.lit(1.0)), F.sqrt(-2 * F.log(F.hypot(s, c))) / (2 * math.pi)


def axial_coherence(angle_deg) -> Column:
    """|mean exp(2 i angle)|: 1 for parallel axes, 0 for scattered ones."""
    a = 2 * F.radians(col(angle_deg))
    return F.hypot(F.avg(F.cos(a)), F.avg(F.sin(a)))


def wrapped_median_deg(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """Median angle in degrees; where a group spans over 180 degrees, angles below 180 count a turn more."""
    span = df.groupBy(*keys).agg((F.max(angle) - F.min(angle)).alias("_span"))
    lifted = join_on(df, span, keys).withColumn("_a", F.when((F.col("_span") > 180) & (F.col(angle) < 180), F.col(angle) + 360).otherwise(F.col(angle)))
    return lifted.groupBy(*keys).agg(F.pmod(median("_a"), F.lit(360.0)).alias("median_deg"))


def roc(df: DataFrame, score: str, is_bad: Column, thresholds: list[float]) -> DataFrame:
    """threshold, flagged rates of bad and good rows: one pass, all thresholds as conditional counts."""
    sums = [F.struct(F.lit(t).alias("threshold"), F.avg(F.when(is_bad, (F.col(score) < t).cast("double"))).alias("bad_rate"), F.avg(F.when(~is_bad, (F.col(score) < t).cast("double"))).alias("good_rate")) for t in thresholds]
    return df.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")
