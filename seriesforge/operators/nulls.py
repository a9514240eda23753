"""What noise alone would give: thresholds of the highest peak, their spread between stars, and how often an alias wins.

A trial takes one star's residuals, moved around their ring of times by some places, so it has the noise of the archive with all its
correlation and no signal. Star and shift are hashes of (seed, series, trial), so trials are rows that any task can make, the same
on any cluster. Rows with NULL or NaN are left out; stars with fewer than five rows are not drawn; a series without any has no row.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite, safe_div
from seriesforge.functions.verdicts import peak_class
from seriesforge.operators.robust import numbered, quantiles
from seriesforge.operators.series import periodogram
from seriesforge.sources.tables import checkpointed, join_on

LEAST_ROWS = 5


def hashed(*parts) -> Column:
    """A number of 32 bits from the text of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 8), 16, 10).cast("long")


def shifted_trials(df: DataFrame, keys: list[str], star: str, t: str, tie: str, y: str, trials: int, seed: int = 0, each_star: bool = False) -> DataFrame:
    """keys, star, trial, t, y: in each trial one star of the series, its values moved around the ring of its times. each_star: the trials are each
    star's own, as if it were alone."""
    rows = df.select(*keys, star, finite(t).alias("t"), F.col(tie).alias("_tie"), finite(y).alias("y")).where("t IS NOT NULL AND y IS NOT NULL")
    ring = checkpointed(numbered(rows, [*keys, star], ["t", "_tie"]))
    stars = ring.groupBy(*keys, star).agg(F.max("_n").alias("_n")).where(F.col("_n") >= LEAST_ROWS)
    group = [*keys, star] if each_star else keys
    pool = stars.select(*keys, star, "_n", (F.row_number().over(Window.partitionBy(*group).orderBy(star)) - 1).alias("_s"), F.count(F.lit(1)).over(Window.partitionBy(*group)).alias("_m"))
    name = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in group]
    drawn = pool.where("_s = 0").select(*group, "_m", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).select(
        *group, "trial", F.pmod(hashed(seed, *name, F.col("trial").cast("string"), "star"), F.col("_m")).alias("_s"), hashed(seed, *name, F.col("trial").cast("string"), "shift").alias("_h")
    )
    chosen = join_on(drawn, pool.select(*group, *([] if each_star else [star]), "_s", "_n"), [*group, "_s"]).select(*keys, star, "trial", F.pmod(F.col("_h"), F.col("_n")).alias("_by"))
    by_star = join_on(ring.select(*keys, star, "_i", "_n", "y"), chosen, [*keys, star])
    moved = by_star.select(*keys, star, "trial", "y", F.pmod(F.col("_i") + F.col("_by"), F.col("_n")).alias("_i"))
    return join_on(moved, ring.select(*keys, star, "_i", "t"), [*keys, star, "_i"]).select(*keys, star, "trial", "t", "y")


def highest_peaks(trials: DataFrame, keys: list[str], low: float, high: float, n: int) -> DataFrame:
    """keys, trial, f, power of the highest point of each trial's periodogram on the grid; with one frequency, its power."""
    grid = periodogram(trials, [*keys, "trial"], "t", "y", None, low, high, n).where("power IS NOT NULL")
    return grid.groupBy(*keys, "trial").agg(F.max(F.struct("power", (-F.col("k")).alias("b"), "f")).alias("m")).select(*keys, "trial", "m.f", "m.power")


def detection_thresholds(df: DataFrame, keys: list[str], star: str, t: str, tie: str, y: str, low: float, high: float, n: int, trials: int = 200, false_alarms: float = 0.01, seed: int = 0) -> DataFrame:
    """keys, trials, threshold, low, high: the power that noise alone passes in a share `false_alarms` of trials, over the whole grid (or at one
    frequency, with n = 1: each statistic against its own null), and the interval of that quantile by the binomial spread of its rank."""
    peaks = highest_peaks(shifted_trials(df, keys, star, t, tie, y, trials, seed), keys, low, high, n)
    q = 1 - false_alarms
    half = 1.96 * math.sqrt(q * false_alarms / max(1, trials))
    out = quantiles(peaks, keys, "power", [q, max(0.0, q - half), min(1.0, q + half)])
    return out.select(*keys, F.col("n").alias("trials"), F.col("q")[0].alias("threshold"), F.col("q")[1].alias("low"), F.col("q")[2].alias("high"))


def threshold_spread(df: DataFrame, keys: list[str], star: str, t: str, tie: str, y: str, low: float, high: float, n: int, trials: int = 100, false_alarms: float = 0.01, seed: int = 0) -> DataFrame:
    """keys, stars, lowest, highest, spread: thresholds of each star by itself, and their range over their median: what trials of a pool of few
    stars hide."""
    peaks = highest_peaks(shifted_trials(df, keys, star, t, tie, y, trials, seed, each_star=True), [*keys, star], low, high, n)
    per = quantiles(peaks, [*keys, star], "power", [1 - false_alarms]).select(*keys, star, F.col("q")[0].alias("threshold"))
    per = checkpointed(per)
    ends = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("stars"), F.min("threshold").alias("lowest"), F.max("threshold").alias("highest"))
    middle = quantiles(per, keys, "threshold", [0.5]).select(*keys, F.col("q")[0].alias("_m"))
    return join_on(ends, middle, keys).select(*keys, "stars", "lowest", "highest", safe_div(F.col("highest") - F.col("lowest"), F.col("_m")).alias("spread"))


def alias_confusion(df: DataFrame, keys: list[str], star: str, t: str, tie: str, y: str, period: float, amplitude: float, low: float, high: float, n: int, trials: int = 100, seed: int = 0) -> DataFrame:
    """keys, trials and the shares true, alias, other of trials whose highest peak is at the frequency of a sinusoid put into the noise, at a daily
    alias of it, or elsewhere. Phases are hashes too."""
    noise = shifted_trials(df, keys, star, t, tie, y, trials, seed)
    name = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    phase = hashed(seed, *name, F.col("trial").cast("string"), "phase") / float(1 << 32)
    peaks = highest_peaks(noise.withColumn("y", F.col("y") + amplitude * F.sin(2 * math.pi * (F.col("t") / period + phase))), keys, low, high, n)
    kind = peak_class(F.col("f"), F.lit(1 / period))
    return peaks.withColumn("_c", kind).groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), *[F.avg((F.col("_c") == c).cast("double")).alias(c) for c in ("true", "alias", "other")])


def injection_recovery(df: DataFrame, keys: list[str], star: str, t: str, tie: str, y: str, period: float, amplitudes: list[float], trials: int = 20, seed: int = 0) -> DataFrame:
    """keys, amplitude, trials, recovered: sinusoids of a known period put into shifted noise, and how many are fitted with an amplitude within a third
    of their own. Each trial is a fit of two regressors (cosine, sine) by its sums. A sinusoid of that period is a sum of the two, so a fit of
    noise and sinusoid is the noise's fit and the sinusoid's own terms: the rows are read once, whatever amplitudes there are."""
    noise = shifted_trials(df, keys, star, t, tie, y, trials, seed)
    turn = 2 * math.pi * F.col("t") / period
    rows = noise.select(*keys, "trial", F.cos(turn).alias("_c"), F.sin(turn).alias("_s"), "y")
    sums = rows.groupBy(*keys, "trial").agg(F.count(F.lit(1)).alias("_m"), *[F.covar_pop(a, b).alias(f"_{a[-1]}{b[-1]}") for a, b in (("_c", "_c"), ("_s", "_s"), ("_c", "_s"), ("y", "_c"), ("y", "_s"))])
    det = F.col("_cc") * F.col("_ss") - F.col("_cs") * F.col("_cs")
    solid = (F.col("_m") >= 3) & (F.col("_cc") > 0) & (det > 1e-11 * F.col("_cc") * F.col("_ss"))
    beta = lambda a, b, own: F.when(solid, (F.col(a) * F.col(own) - F.col(b) * F.col("_cs")) / det)
    name = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    phase = 2 * math.pi * hashed(seed, *name, F.col("trial").cast("string"), "phase") / float(1 << 32)
    fit = sums.select(*keys, beta("_yc", "_ys", "_ss").alias("_bc"), beta("_ys", "_yc", "_cc").alias("_bs"), phase.alias("_p"), F.explode(F.array(*[F.lit(float(a)) for a in amplitudes])).alias("amplitude"))
    a = F.col("amplitude")
    ok = F.abs(F.hypot(F.col("_bc") + a * F.sin("_p"), F.col("_bs") + a * F.cos("_p")) - a) <= a / 3
    return fit.groupBy(*keys, "amplitude").agg(F.count(F.lit(1)).alias("trials"), F.count_if(ok).alias("recovered"))
