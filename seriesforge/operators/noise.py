"""What a set of measurements achieves: scatter of stars, noise curves and floors, thresholds, photon transfer, nightly summaries.

Everything is an aggregate or a window over rows that were aggregated before. Rows with NULL or NaN where a value is needed
are left out; a group with too few rows gives NULLs; NULL keys make a group of their own; an empty table gives an empty one.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import col
from seriesforge.operators.robust import median, median_and_mad
from seriesforge.sources.tables import join_on

#: The error below which no magnitude is weighted, and the ratio of the errors of a median and of a mean.
WEIGHT_FLOOR = 0.005
MEDIAN_ERROR = math.sqrt(math.pi / 2)


def real(x) -> Column:
    """The value as a double; NaN becomes NULL."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def finite(*columns) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & real(c).isNotNull()
    return ok


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def star_stats(df: DataFrame, keys: list[str], mag: str, sigma: str, zero: str) -> DataFrame:
    """keys, n, mean, rms, chi2nu of magnitudes less their frame's zero point: weighted mean, unweighted scatter about it, and
    chi square for each degree of freedom of a constant star (NULL for one row). Rows come back to their mean by a join on the keys."""
    rows = df.where(finite(mag, sigma, zero)).select(*keys, (real(mag) - real(zero)).alias("_c"), (real(sigma) ** 2 + WEIGHT_FLOOR**2).alias("_v"))
    means = rows.groupBy(*keys).agg((F.sum(F.col("_c") / F.col("_v")) / F.sum(1 / F.col("_v"))).alias("_m"))
    d2 = (F.col("_c") - F.col("_m")) ** 2
    n = F.count(F.lit(1))
    return join_on(rows, means, keys).groupBy(*keys).agg(n.alias("n"), F.first("_m").alias("mean"), F.sqrt(F.avg(d2)).alias("rms"), F.when(n > 1, F.sum(d2 / F.col("_v")) / (n - 1)).alias("chi2nu"))


def inflation_factor(chi2nu) -> Column:
    """Factor that brings formal errors to the scatter of stars known to be constant."""
    return F.sqrt(median(real(chi2nu)))


def total_sigma(sigma, zero_error, floor: float = 0.0) -> Column:
    """Photon error, error of the zero point (NULL: none) and floor in quadrature."""
    return F.sqrt(col(sigma) ** 2 + F.coalesce(col(zero_error) ** 2, F.lit(0.0)) + floor**2)


def noise_curve(df: DataFrame, keys: list[str], x: str, y: str, width: float = 0.5) -> DataFrame:
    """keys, centre, n, median of y in bins of x that begin at multiples of the width."""
    rows = df.where(finite(x, y)).select(*keys, ((F.floor(real(x) / width) + 0.5) * width).alias("centre"), real(y).alias("_y"))
    return rows.groupBy(*keys, "centre").agg(F.count("_y").alias("n"), median("_y").alias("median"))


def plateau(curve: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """keys, floor, centre, n: the least median of the bins of a curve with `least` rows; of equal ones the first bin."""
    best = F.min(F.when(F.col("n") >= least, F.struct("median", "centre", "n"))).alias("_b")
    return curve.groupBy(*keys).agg(best).select(*keys, F.col("_b.median").alias("floor"), F.col("_b.centre").alias("centre"), F.coalesce(F.col("_b.n"), F.lit(0)).alias("n"))


def precision_at(x, y, at: float, half: float = 0.5) -> tuple[Column, Column]:
    """Median of y, and count, over rows with x within `half` of `at`."""
    ok = finite(x, y) & (F.abs(real(x) - at) <= half)
    return median(F.when(ok, real(y))), F.count_if(ok)


def noise_floor(rms, predicted) -> dict[str, Column]:
    """floor and k of rms^2 = k predicted^2 + floor^2, by least squares on relative residuals; n rows used, at least three.
    Negative solutions are zero."""
    ok = finite(rms, predicted) & (real(rms) > 0) & (real(predicted) > 0)
    a, b = (real(predicted) / real(rms)) ** 2, real(rms) ** -2
    s = lambda e: F.sum(F.when(ok, e))
    n, aa, ab, bb, sa, sb = F.count_if(ok), s(a * a), s(a * b), s(b * b), s(a), s(b)
    det = aa * bb - ab * ab
    solve = lambda e: F.when(n >= 3, F.greatest(ratio(e, det), F.lit(0.0)))
    return {"floor": F.sqrt(solve(aa * sb - ab * sa)), "k": solve(bb * sa - ab * sb), "n": n}


def allan_slope(tau, deviation) -> Column:
    """Slope of log deviation over log time: -0.5 for white noise. NULL for fewer than three rungs."""
    ok = finite(tau, deviation) & (real(tau) > 0) & (real(deviation) > 0)
    return F.when(F.count_if(ok) >= 3, F.regr_slope(F.when(ok, F.log10(real(deviation))), F.when(ok, F.log10(real(tau)))))


def red_noise(tau, deviation, target: float) -> dict[str, Column]:
    """factor by which the deviation at the last rung up to `target` exceeds that of white noise from the first rung, and that rung as tau_used."""
    ok = finite(tau, deviation) & (real(tau) > 0) & (real(deviation) > 0)
    rung = F.struct(real(tau).alias("t"), real(deviation).alias("d"))
    first, last = F.min(F.when(ok, rung)), F.max(F.when(ok & (real(tau) <= target), rung))
    enough = F.count_if(ok) >= 2
    return {"factor": F.when(enough, last["d"] / (first["d"] * F.sqrt(first["t"] / last["t"]))), "tau_used": F.when(enough, last["t"])}


def degradation(curve: DataFrame, keys: list[str], factor: float = 1.3, least: int = 15, run: int = 2, baseline: float | None = None) -> DataFrame:
    """keys, baseline, threshold: the first bin of a noise_curve that begins a run of `run` bins above factor times the baseline.

    Without a baseline it is the least median of the bins with `least` rows, and only bins beyond that one count. Bins with fewer
    rows break a run. The last full bin may stand alone. No such bin: NULL, the axis does not limit.
    """
    own, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("centre")
    full = (F.col("n") >= least) & F.col("median").isNotNull()
    best = F.min(F.when(full, F.struct("median", "centre"))).over(own)
    base = curve.withColumn("_full", full).withColumn("baseline", best["median"] if baseline is None else F.lit(float(baseline)))
    base = base.withColumn("_after", F.col("centre") > best["centre"] if baseline is None else F.lit(True)).withColumn("_last", F.max(F.when(full, F.col("centre"))).over(own))
    over = base.withColumn("_over", F.col("_full") & (F.col("median") > factor * F.col("baseline")))
    begun = F.count_if(F.col("_over")).over(ordered.rowsBetween(0, run - 1)) == run
    marked = over.withColumn("_run", begun & F.col("_after")).withColumn("_end", F.col("_over") & F.col("_after") & (F.col("centre") == F.col("_last")))
    first = F.coalesce(F.min(F.when(F.col("_run"), F.col("centre"))), F.min(F.when(F.col("_end"), F.col("centre"))))
    return marked.groupBy(*keys).agg(F.first("baseline").alias("baseline"), first.alias("threshold"))


def photon_transfer(level, variance, n_pix) -> dict[str, Column]:
    """gain, gain_error, read_noise (in counts), read_noise_e and n of the line variance = read noise^2 + level / gain, points weighted by
    the root of their pixels. NULL for fewer than three points, one level, or a slope that is not above zero."""
    ok = finite(level, variance, n_pix)
    w, x, y = F.sqrt(real(n_pix)), real(level), real(variance)
    s = lambda e: F.sum(F.when(ok, e))
    n, sw = F.count_if(ok), s(w)
    xm, ym = ratio(s(w * x), sw), ratio(s(w * y), sw)
    sxx, sxy, syy = ratio(s(w * x * x), sw) - xm * xm, ratio(s(w * x * y), sw) - xm * ym, ratio(s(w * y * y), sw) - ym * ym
    slope = F.when((n >= 3) & (sxx > 0), sxy / sxx)
    slope = F.when(slope > 0, slope)
    scatter = F.greatest(syy - slope * sxy, F.lit(0.0)) * n / F.greatest(n - 2, F.lit(1))
    noise = F.sqrt(F.greatest(ym - slope * xm, F.lit(0.0)))
    known = lambda e: F.when(slope.isNotNull(), e)
    return {"gain": 1 / slope, "gain_error": known(F.sqrt(scatter / (sxx * n)) / slope**2), "read_noise": known(noise), "read_noise_e": known(noise / slope), "n": n}


def dark_floor(df: DataFrame, keys: list[str], exposure: str, level: str, variance: str) -> DataFrame:
    """keys, exposure, offset, floor, n for each exposure: the median variance of the points within 5 % of its least level."""
    rows = df.where(finite(exposure, level, variance) & (real(variance) >= 0)).select(*keys, real(exposure).alias("exposure"), real(level).alias("_l"), real(variance).alias("_v"))
    least = rows.groupBy(*keys, "exposure").agg(F.min("_l").alias("offset"))
    near = join_on(rows, least, [*keys, "exposure"]).where(F.col("_l") <= 1.05 * F.col("offset"))
    return near.groupBy(*keys, "exposure").agg(F.first("offset").alias("offset"), median("_v").alias("floor"), F.count("_v").alias("n"))


def dark_noise(floors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, read_noise of the shortest exposure of dark_floor, and the share of its variance that is the shot noise of the dark current,
    by the growth up to the longest one (NULL where nothing grows)."""
    at = F.struct("exposure", "floor")
    ends = floors.groupBy(*keys).agg(F.min(at).alias("_s"), F.max(at).alias("_l"))
    t0, v0, t1, v1 = F.col("_s.exposure"), F.col("_s.floor"), F.col("_l.exposure"), F.col("_l.floor")
    share = F.when((v1 > v0) & (v0 > 0) & (t1 > t0), (v1 - v0) * t0 / (t1 - t0) / v0)
    return ends.select(*keys, F.sqrt(v0).alias("read_noise"), share.alias("dark_share"))


def band_offset(df: DataFrame, keys: list[str], night: str, band: str, mag: str, wanted: str, reference: list[str]) -> DataFrame:
    """keys, n, median, mad_sigma of the wanted band less the reference bands, over nights that have both (medians by night)."""
    of = lambda p: median(F.when(p, real(mag)))
    b = F.col(band)
    nights = df.where(b.isin(wanted, *reference)).groupBy(*keys, night).agg((of(b == wanted) - of(b.isin(reference) & (b != wanted))).alias("_d"))
    return median_and_mad(nights.where(F.col("_d").isNotNull()), keys, "_d")


def quiescent_baseline(nights: DataFrame, keys: list[str], mag: str, share: float = 0.1, least: int = 5) -> DataFrame:
    """keys, baseline: median of the faintest share of the nightly magnitudes, at least one; NULL for fewer than `least` nights."""
    rows = nights.where(finite(mag)).select(*keys, real(mag).alias("_m"))
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_m")))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    faint = F.col("_r") <= F.greatest(F.bround(F.col("_n") * share), F.lit(1))
    return numbered.groupBy(*keys).agg(F.when(F.first("_n") >= least, median(F.when(faint, F.col("_m")))).alias("baseline"))


def coverage(df: DataFrame, keys: list[str], t: str, night: str, band: str) -> DataFrame:
    """keys, n, first, last, bands, n_nights, median_gap (days from one observed night to the next)."""
    nights = df.groupBy(*keys, night).agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_a"), F.max(t).alias("_b"), F.collect_set(band).alias("_bands"))
    gap = F.date_diff(F.col(night), F.lag(night).over(Window.partitionBy(*keys).orderBy(night)))
    bands = F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list("_bands")))))
    return nights.withColumn("_gap", gap).groupBy(*keys).agg(F.sum("_n").alias("n"), F.min("_a").alias("first"), F.max("_b").alias("last"), bands.alias("bands"), F.count(night).alias("n_nights"), median("_gap").alias("median_gap"))


def median_floor(curves: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, n, median, error of that median over several curves."""
    return median_and_mad(curves, keys, x).withColumn("error", MEDIAN_ERROR * F.col("mad_sigma") / F.sqrt("n")).drop("mad_sigma")


def plateau_span(nights: DataFrame, keys: list[str], night: str, mag: str, depth: float = 1.5) -> DataFrame:
    """keys, peak_night, start, stop, days: the unbroken stretch of nights around the brightest one of a group (one episode) that stay
    within `depth` of it. Of equal peaks the first; one row for each night is expected."""
    own = Window.partitionBy(*keys)
    rows = nights.where(finite(mag) & F.col(night).isNotNull()).select(*keys, F.col(night).alias("_d"), real(mag).alias("_m"))
    rows = rows.withColumn("_p", F.min(F.struct("_m", "_d")).over(own)).withColumn("_faded", F.col("_m") > F.col("_p._m") + depth)
    before = F.max(F.when(F.col("_faded") & (F.col("_d") < F.col("_p._d")), F.col("_d"))).over(own)
    after = F.min(F.when(F.col("_faded") & (F.col("_d") > F.col("_p._d")), F.col("_d"))).over(own)
    inside = rows.withColumn("_before", before).withColumn("_after", after).where(F.coalesce(F.col("_d") > F.col("_before"), F.lit(True)) & F.coalesce(F.col("_d") < F.col("_after"), F.lit(True)))
    out = inside.groupBy(*keys).agg(F.first("_p._d").alias("peak_night"), F.min("_d").alias("start"), F.max("_d").alias("stop"))
    return out.withColumn("days", F.date_diff("stop", "start") + 1)


def two_sided(phase, width: float = 0.0) -> tuple[Column, Column]:
    """Points before and after phase zero, those within the width left out."""
    return F.count_if(real(phase) < -abs(width)), F.count_if(real(phase) > abs(width))


def remaining_seconds(df: DataFrame, stratum: str, pending: Column, seconds: str, priors: dict[str, float], workers: int, least: int = 20, default: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """For each stratum pending rows and the median seconds of its finished rows (its prior below `least` of them); and the time that all
    pending rows take with so many workers."""
    prior = F.coalesce(F.create_map(*[F.lit(x) for kv in priors.items() for x in kv])[F.col(stratum)], F.lit(default)) if priors else F.lit(default)
    done = F.when(~pending, real(seconds))
    by = df.groupBy(stratum).agg(F.count_if(pending).alias("pending"), F.count(done).alias("done"), median(done).alias("_m"))
    by = by.select(stratum, "pending", F.when(F.col("done") >= least, F.col("_m")).otherwise(prior).alias("median_s"))
    return by, by.agg((F.coalesce(F.sum(F.col("pending") * F.col("median_s")), F.lit(0.0)) / workers if workers > 0 else F.lit(0.0)).alias("eta_s"))
