"""Lines of spectra: residuals of a running continuum, the strongest emission, absorption dips, and the pair that fixes the scale.

A spectrum is rows of (keys, x, flux), one for each pixel of its detector, so a spectrum has a bound and windows run over one at a
time. NULL and NaN flux takes part in no peak and no dip; its place in the continuum is taken by the spectrum's median. Spectra without
a feature have no row in its table; NULL keys make a group of their own; empty tables give empty ones.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite
from seriesforge.operators.robust import median_and_mad, quantiles
from seriesforge.operators.series import running_median
from seriesforge.sources.tables import checkpointed, join_on

#: Wavelengths of the emission line and of the two band heads; pixels of the continuum's window; least height of a peak and
#: its widths; least depth of a dip, its least pixels and the gap that it bridges; tolerance of the pair's ratio; dispersion in A/px.
LINE, BAND_B, BAND_A = 6562.8, 6867.2, 7593.7
WINDOW = 151
PEAK_SNR, PEAK_WIDTHS = 8.0, (3, 80)
DIP_SNR, DIP_PIXELS, DIP_GAP = 5.0, 2, 5
RATIO_TOLERANCE, DISPERSION = 0.06, (0.3, 3.0)


def residuals(df: DataFrame, keys: list[str], x: str, flux: str, window: int = WINDOW) -> DataFrame:
    """keys, x, residual (0 where there is no flux), noise: flux less its running median, and the robust scatter of that in the spectrum."""
    rows = df.select(*keys, F.col(x).cast("long").alias("x"), finite(flux).alias("_f")).where("x IS NOT NULL")
    middle = quantiles(rows, keys, "_f", [0.5]).select(*keys, F.col("q")[0].alias("_m"))
    filled = join_on(rows, middle, keys).withColumn("_y", F.coalesce("_f", "_m"))
    out = running_median(filled, keys, "x", "x", "_y", window // 2, "_c").select(*keys, "x", (F.col("_f") - F.col("_c")).alias("_r"))
    out = checkpointed(out)
    noise = median_and_mad(out, keys, "_r").select(*keys, F.greatest(F.coalesce("mad_sigma", F.lit(0.0)), F.lit(1e-9)).alias("noise"))
    return join_on(out, noise, keys).select(*keys, "x", F.coalesce("_r", F.lit(0.0)).alias("residual"), "noise")


def run_around(rows: DataFrame, at: DataFrame, keys: list[str], own: list[str], inside) -> DataFrame:
    """at (keys, own, _i and what `inside` needs) with _lo and _hi: the run of pixels about _i for which `inside` holds, ends of the spectrum included."""
    met = join_on(rows, at, keys)
    stop = ~inside
    ends = met.groupBy(*keys, *own).agg(
        F.coalesce(F.max(F.when(stop & (F.col("x") < F.col("_i")), F.col("x"))) + 1, F.min("x")).alias("_lo"), F.coalesce(F.min(F.when(stop & (F.col("x") > F.col("_i")), F.col("x"))) - 1, F.max("x")).alias("_hi")
    )
    return join_on(at, ends, [*keys, *own])


def emission_peaks(rows: DataFrame, keys: list[str], least: float = PEAK_SNR, widths: tuple[int, int] = PEAK_WIDTHS) -> DataFrame:
    """keys, x (centroid over the half-maximum span), snr, width_px of the highest residual of each spectrum (stored residuals()), if it is high enough
    and neither a hit nor a slope."""
    top = rows.groupBy(*keys).agg(F.max(F.struct("residual", (-F.col("x")).alias("_b"), "noise")).alias("m")).select(*keys, (-F.col("m._b")).alias("_i"), F.col("m.residual").alias("_h"), F.col("m.noise").alias("_n"))
    high = top.where((F.col("_h") >= least * F.col("_n")) & (F.col("_h") > 0))
    span = run_around(rows, high, keys, ["_i", "_h", "_n"], F.col("residual") > F.col("_h") / 2)
    span = span.where((F.col("_hi") - F.col("_lo") + 1).between(*widths))
    inside = join_on(rows, span, keys).where(F.col("x").between(F.col("_lo"), F.col("_hi")))
    return inside.groupBy(*keys).agg((F.sum(F.col("residual") * F.col("x")) / F.sum("residual")).alias("centroid"), (F.first("_h") / F.first("_n")).alias("snr"), (F.first("_hi") - F.first("_lo") + 1).alias("width_px")).withColumnRenamed("centroid", "x")


def dips(rows: DataFrame, keys: list[str], least: float = DIP_SNR, pixels: int = DIP_PIXELS, gap: int = DIP_GAP) -> DataFrame:
    """keys, x (lowest pixel), snr, width_px (below half its depth) of every run of pixels that lie `least` noises below the continuum; runs go on over gaps
    of up to `gap` pixels."""
    low = rows.where(F.col("residual") < -least * F.col("noise"))
    w = Window.partitionBy(*keys).orderBy("x")
    runs = low.withColumn("_new", F.coalesce((F.col("x") - F.lag("x").over(w) > gap).cast("int"), F.lit(0))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("residual", "x", "noise")).alias("m")).where(F.col("_c") >= pixels)
    at = found.select(*keys, "_run", F.col("m.x").alias("_i"), (-F.col("m.residual")).alias("_d"), F.col("m.noise").alias("_n"))
    span = run_around(rows, at, keys, ["_run", "_i", "_d", "_n"], F.col("residual") < -F.col("_d") / 2)
    return span.select(*keys, F.col("_i").alias("x"), (F.col("_d") / F.col("_n")).alias("snr"), (F.col("_hi") - F.col("_lo") + 1).alias("width_px"))


def anchor_pairs(peaks: DataFrame, found: DataFrame, keys: list[str], line: float = LINE, band_b: float = BAND_B, band_a: float = BAND_A, tolerance: float = RATIO_TOLERANCE, dispersion: tuple[float, float] = DISPERSION) -> DataFrame:
    """keys, x_b, snr_b, x_a, snr_a, a_per_px (signed): of two dips on one side of the peak whose distances from it stand in the ratio of the bands', and
    whose scale is possible, the pair with the most snr. A spectrum has few dips; they meet within it only."""
    ratio, reach = (band_a - line) / (band_b - line), band_a - line
    side = lambda n: found.select(*keys, F.col("x").alias(f"x_{n}"), F.col("snr").alias(f"snr_{n}"))
    both = join_on(join_on(peaks.select(*keys, F.col("x").alias("_p")), side("b"), keys), side("a"), keys)
    b, a = F.col("x_b") - F.col("_p"), F.col("x_a") - F.col("_p")
    scale = reach / F.when(a != 0, a)
    fits = (a * b > 0) & (a / F.when(b != 0, b)).between(ratio * (1 - tolerance), ratio * (1 + tolerance)) & F.abs(scale).between(*dispersion)
    best = both.where(fits).groupBy(*keys).agg(F.max(F.struct((F.col("snr_b") + F.col("snr_a")).alias("s"), "snr_b", (-F.col("x_b")).alias("nb"), (-F.col("x_a")).alias("na"), "x_b", "x_a", "snr_a", scale.alias("a_per_px"))).alias("m"))
    return best.select(*keys, "m.x_b", "m.snr_b", "m.x_a", "m.snr_a", "m.a_per_px")


def anchors(df: DataFrame, keys: list[str], x: str, flux: str, window: int = WINDOW) -> DataFrame:
    """keys, x_line, snr_line, width_line, x_b, snr_b, x_a, snr_a, a_per_px, status (line+bands, line_only, none): everything that fixes a spectrum's scale."""
    rows = checkpointed(residuals(df, keys, x, flux, window))
    peaks = checkpointed(emission_peaks(rows, keys))
    pairs = anchor_pairs(peaks, dips(rows, keys), keys)
    out = join_on(join_on(rows.select(*keys).distinct(), peaks.select(*keys, F.col("x").alias("x_line"), F.col("snr").alias("snr_line"), F.col("width_px").alias("width_line")), keys, "left"), pairs, keys, "left")
    return out.withColumn("status", F.when(F.col("x_line").isNull(), "none").when(F.col("a_per_px").isNull(), "line_only").otherwise("line+bands"))


def snippets(df: DataFrame, keys: list[str], x: str, flux: str, centres: DataFrame, half: int = 150, stride: int = 3) -> DataFrame:
    """keys, offset, flux: every `stride`-th pixel about each spectrum's centre (keys, x) as far as `half`, over the spectrum's median there."""
    centre = centres.select(*keys, F.round("x").cast("long").alias("_c"))
    near = join_on(df.select(*keys, F.col(x).cast("long").alias("_x"), finite(flux).alias("_f")), centre, keys).withColumn("offset", F.col("_x") - F.col("_c")).where(F.abs("offset") <= half)
    level = quantiles(near, keys, "_f", [0.5]).where(F.col("q")[0] != 0).select(*keys, F.col("q")[0].alias("_m"))
    return join_on(near, level, keys).where(F.pmod(F.col("offset"), F.lit(stride)) == 0).select(*keys, "offset", (F.col("_f") / F.col("_m")).alias("flux"))
