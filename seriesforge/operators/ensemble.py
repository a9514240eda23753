"""Ensemble photometry: zero points of frames and magnitudes of stars as alternating aggregates, comparison stars, flux of a fixed ensemble.

The solution alternates between two keyed tables, one row for each star and one for each frame. A round joins the rows with the
one and aggregates to the other, so a series of any size is never in one place; each round's table is written. NULL and NaN
measurements and errors that are not positive are left out; NULL keys make a group of their own; empty tables give empty ones.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import finite, safe_div
from seriesforge.operators.robust import quantiles
from seriesforge.sources.tables import checkpointed, join_on

#: The floor of a weight's error, the share of frames that a candidate is on, the cut on the scatter (a factor and a
#: floor), the least comparison stars, the stars held out to check, and the share of frames that a core star is on.
WEIGHT_FLOOR = 0.005
CANDIDATE_SHARE = 0.5
RMS_FACTOR, RMS_FLOOR = 2.5, 0.02
LEAST_COMPS, CHECKS = 5, 4
CORE_SHARE = 0.8


def measurements(df: DataFrame, series: str, star: str, frame: str, mag: str, sigma: str) -> DataFrame:
    s = finite(sigma)
    rows = df.select(F.col(series).alias("_k"), F.col(star).alias("_s"), F.col(frame).alias("_f"), finite(mag).alias("_y"), F.when(s > 0, 1 / (s * s + WEIGHT_FLOOR**2)).alias("_w"))
    return rows.dropna(subset=["_s", "_f", "_y", "_w"])


def two_way_solution(rows: DataFrame, most: int = 200, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Stars (_k, _s, _m, _n) and frames (_k, _f, _z, _n) of measurements() (stored): y = m + z in weighted least squares, frames of mean zero in
    each series; rounds end when no frame moves by more than the tolerance, or after `most`."""
    level = F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")

    def stars(frames: DataFrame) -> DataFrame:
        met = join_on(rows, frames.select("_k", "_f", "_z"), ["_k", "_f"]).withColumn("_y", F.col("_y") - F.col("_z"))
        return met.groupBy("_k", "_s").agg(level.alias("_m"), F.count(F.lit(1)).alias("_n"))

    frames = rows.groupBy("_k", "_f").agg(F.lit(0.0).alias("_z"), F.count(F.lit(1)).alias("_n"))
    for _ in range(most):
        met = join_on(rows, stars(frames).select("_k", "_s", "_m"), ["_k", "_s"]).withColumn("_y", F.col("_y") - F.col("_m"))
        raw = met.groupBy("_k", "_f").agg(level.alias("_z"), F.count(F.lit(1)).alias("_n"))
        raw = checkpointed(raw)
        new = join_on(raw, raw.groupBy("_k").agg(F.avg("_z").alias("_c")), ["_k"]).withColumn("_z", F.col("_z") - F.col("_c")).drop("_c")
        moved = join_on(new, frames.select("_k", "_f", F.col("_z").alias("_old")), ["_k", "_f"]).agg(F.max(F.abs(F.col("_z") - F.col("_old")))).first()[0]
        frames = new
        if moved is None or moved < tolerance:
            break
    return checkpointed(stars(frames)), frames


def residuals(rows: DataFrame, stars: DataFrame, frames: DataFrame) -> DataFrame:
    both = join_on(join_on(rows, stars.select("_k", "_s", "_m"), ["_k", "_s"]), frames.select("_k", "_f", "_z"), ["_k", "_f"])
    return both.withColumn("_r", F.col("_y") - F.col("_m") - F.col("_z"))


def clipped_solution(rows: DataFrame, clip: float = 4.0, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """two_way_solution; after each pass, rows beyond `clip` times the rms of all residuals of their series go."""
    kept = rows
    stars, frames = two_way_solution(kept)
    for _ in range(passes):
        left = residuals(kept, stars, frames)
        bound = left.groupBy("_k").agg((clip * F.sqrt(F.avg(F.col("_r") ** 2))).alias("_b"))
        fewer = checkpointed(join_on(left, bound, ["_k"]).where(F.abs("_r") <= F.col("_b")).select("_k", "_s", "_f", "_y", "_w"))
        if fewer.count() == kept.count():
            break
        kept = fewer
        stars, frames = two_way_solution(kept)
    return stars, frames


def ensembles(df: DataFrame, series: str, star: str, frame: str, mag: str, sigma: str) -> DataFrame:
    """series, kind ('star' or 'frame'), id, value, n: the clipped solution of each series; NULL for a star or frame that lost all its rows."""
    rows = checkpointed(measurements(df, series, star, frame, mag, sigma))
    stars, frames = clipped_solution(rows)
    out = None
    for kind, found, key, value in (("star", stars, "_s", "_m"), ("frame", frames, "_f", "_z")):
        every = join_on(rows.select("_k", key).distinct(), found, ["_k", key], "left")
        part = every.select(F.col("_k").alias(series), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(value).alias("value"), F.coalesce("_n", F.lit(0)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def comparison_stars(df: DataFrame, series: str, star: str, frame: str, mag: str, sigma: str, is_target: Column | None = None, is_barred: Column | None = None, checks: int = CHECKS, passes: int = 10, rounds: int = 20) -> DataFrame:
    """series, star, role, n, median_mag, rms: comparison stars by pruning to a fixed point.

    Candidates are on half of the series' frames or more and neither target nor barred. Each pass solves the stars that are left,
    takes the rms of each one's residuals, and drops those beyond 2.5 times the median rms (0.02 at least), but for the five
    quietest; it ends when none goes. Then the `checks` nearest the target's median magnitude (without a target, the comparison
    stars' median) are held out while five stay. role: target, comp, check, dropped_unstable, field.
    """
    marked = df.withColumn("_t", F.lit(False) if is_target is None else F.coalesce(is_target, F.lit(False))).withColumn("_x", F.lit(False) if is_barred is None else F.coalesce(is_barred, F.lit(False)))
    rows = checkpointed(measurements(marked, series, star, frame, mag, sigma))
    flags = marked.groupBy(F.col(series).alias("_k"), F.col(star).alias("_s")).agg(F.max("_t").alias("target"), F.max("_x").alias("barred"))
    seen = rows.groupBy("_k", "_s").agg(F.count_distinct("_f").alias("n"))
    frames = rows.groupBy("_k").agg(F.count_distinct("_f").alias("_frames"))
    medians = quantiles(rows, ["_k", "_s"], "_y", [0.5]).select("_k", "_s", F.col("q")[0].alias("median_mag"))
    every = checkpointed(join_on(join_on(join_on(flags, seen, ["_k", "_s"], "left"), medians, ["_k", "_s"], "left"), frames, ["_k"], "left"))
    candidates = every.where((F.col("n") >= CANDIDATE_SHARE * F.col("_frames")) & ~F.col("target") & ~F.col("barred"))
    comps = checkpointed(candidates.select("_k", "_s", F.lit(None).cast("double").alias("rms")))
    for _ in range(passes):
        left = checkpointed(join_on(rows, comps.select("_k", "_s"), ["_k", "_s"]))
        stars, zeros = two_way_solution(left, rounds)
        scatter = checkpointed(residuals(left, stars, zeros).groupBy("_k", "_s").agg(F.sqrt(F.avg(F.col("_r") ** 2)).alias("rms")))
        sizes = scatter.groupBy("_k").agg(F.count(F.lit(1)).alias("_all"))
        cut = quantiles(scatter, ["_k"], "rms", [0.5]).select("_k", F.greatest(RMS_FACTOR * F.col("q")[0], F.lit(RMS_FLOOR)).alias("_cut"))
        quiet = quietest(scatter, LEAST_COMPS)
        judged = join_on(join_on(join_on(scatter, sizes, ["_k"]), cut, ["_k"]), quiet, ["_k", "_s"], "left").withColumn("_ok", F.col("rms") <= F.col("_cut"))
        enough = judged.groupBy("_k").agg(F.count_if(F.col("_ok")).alias("_kept"))
        judged = join_on(judged, enough, ["_k"])
        stays = (F.col("_all") < LEAST_COMPS) | F.when(F.col("_kept") >= LEAST_COMPS, F.col("_ok")).otherwise(F.col("_place").isNotNull())
        new = checkpointed(judged.where(stays).select("_k", "_s", "rms"))
        done = new.count() == comps.count()
        comps = new
        if done:
            break
    anchor = every.where("target").groupBy("_k").agg(F.min("median_mag").alias("_anchor"))
    in_comps = join_on(every, comps.select("_k", "_s", "rms"), ["_k", "_s"])
    middle = quantiles(in_comps, ["_k"], "median_mag", [0.5]).select("_k", F.col("q")[0].alias("_middle"), F.col("n").alias("_comps"))
    near = join_on(join_on(in_comps, middle, ["_k"]), anchor, ["_k"], "left").withColumn("rms", F.abs(F.col("median_mag") - F.coalesce("_anchor", "_middle")))
    held = quietest(near, checks, carry="_comps").where(F.col("_place") <= F.col("_comps") - LEAST_COMPS).select("_k", "_s", F.lit(True).alias("_check"))
    roles = join_on(join_on(every, comps.select("_k", "_s", "rms", F.lit(True).alias("_comp")), ["_k", "_s"], "left"), held, ["_k", "_s"], "left")
    was = (F.col("n") >= CANDIDATE_SHARE * F.col("_frames")) & ~F.col("barred")
    role = F.when(F.col("target"), "target").when(F.col("_check"), "check").when(F.col("_comp"), "comp").when(was, "dropped_unstable").otherwise("field")
    return roles.select(F.col("_k").alias(series), F.col("_s").alias(star), role.alias("role"), F.coalesce("n", F.lit(0)).alias("n"), "median_mag", "rms")


def quietest(rows: DataFrame, most: int, carry: str | None = None) -> DataFrame:
    """_k, _s, _place (from 1): the `most` rows of least rms of each series, ties to the least star. First of each of 32 shares, then of what is left."""
    extra = [carry] if carry else []
    first = rows.withColumn("_deal", F.pmod(F.xxhash64("_s"), F.lit(32))).withColumn("_p", F.row_number().over(Window.partitionBy("_k", "_deal").orderBy("rms", "_s"))).where(F.col("_p") <= most)
    return first.withColumn("_place", F.row_number().over(Window.partitionBy("_k").orderBy("rms", "_s"))).where(F.col("_place") <= most).select("_k", "_s", "_place", *extra)


def flux_ratio(df: DataFrame, keys: list[str], star: str, frame: str, rate: str, share: float = CORE_SHARE) -> DataFrame:
    """keys, frame, ratio, n: flux of the core stars on a frame over the same stars' median flux. Core stars are on `share` of the night's frames or
    more; frames without one have NULL. Measurements of a star on a frame that repeat count once towards its presence."""
    rows = checkpointed(df.select(*keys, F.col(star).alias("_s"), F.col(frame).alias("_f"), finite(rate).alias("_y")))
    frames = rows.groupBy(*keys).agg(F.count_distinct("_f").alias("_frames"))
    seen = join_on(rows.groupBy(*keys, "_s").agg(F.count_distinct("_f").alias("_n")), frames, keys).where(F.col("_n") >= share * F.col("_frames"))
    good = rows.where("_y > 0")
    normal = join_on(quantiles(good, [*keys, "_s"], "_y", [0.5]).select(*keys, "_s", F.col("q")[0].alias("_m")), seen.select(*keys, "_s"), [*keys, "_s"])
    sums = join_on(good, normal, [*keys, "_s"]).groupBy(*keys, "_f").agg(F.sum("_y").alias("_a"), F.sum("_m").alias("_b"), F.count(F.lit(1)).alias("n"))
    every = join_on(rows.select(*keys, "_f").distinct(), sums, [*keys, "_f"], "left")
    return every.select(*keys, F.col("_f").alias(frame), safe_div(F.col("_a"), F.col("_b")).alias("ratio"), F.coalesce("n", F.lit(0)).alias("n"))
