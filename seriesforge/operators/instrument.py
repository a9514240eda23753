"""What frames tell of their instrument and their pointing: variance of frame pairs, pile-up of levels, exposure ladders, offsets by
voting, ranges of sky cells.

Rows are binned and counted before anything is ordered; what is ordered afterwards has one row for each level, rung or cell. NULL and
NaN values are left out; NULL keys make a group of their own; empty tables give empty ones.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import MAD_TO_SIGMA, col, finite, safe_div
from seriesforge.operators.joins import asof
from seriesforge.operators.robust import quantiles
from seriesforge.sources.tables import checkpointed, join_on

#: Fixed values. Frame pairs: clipping bound and rounds, least pixels of a bin.
CLIP_SIGMA, CLIP_ROUNDS, LEAST_PIXELS = 4.0, 2, 2000
#: Pile-up: least height over the valley, levels of the window at the top, levels in which the valley is sought, least pixels of a dense
#: level, least level.
PILE_RATIO, PILE_WINDOW, VALLEY_SPAN, DENSE, LEAST_LEVEL = 10.0, 160, 300, 1000, 500
#: Ladders: least rungs and least frames of a rung.
LEAST_RUNGS, LEAST_FRAMES = 3, 2
#: Offsets: width of a cell, least votes, least share of the shorter list.
VOTE_CELL, LEAST_VOTES, VOTE_SHARE = 4.0, 8, 0.15
#: Sky cells: the level at which ids are cut into cells, of ids that carry level 12 from bit 35 on.
CELL_LEVEL = 9


# frame pairs


def clipped_pair_variance(df: DataFrame, keys: list[str], d: str, rounds: int = CLIP_ROUNDS, bound: float = CLIP_SIGMA) -> DataFrame:
    """keys, var, n: half the variance of the differences d that stay within `bound` robust sigmas of their median, round after round. A round is
    a table of bounds, one row a group; the rows are read, never rewritten. NULL for fewer than two rows."""
    rows = df.select(*keys, finite(d).alias("_d")).where("_d IS NOT NULL")
    limits = None
    for _ in range(rounds):
        kept = rows if limits is None else join_on(rows, limits, keys).where(F.col("_d").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
        middle = checkpointed(quantiles(kept, keys, "_d", [0.5]).select(*keys, F.col("q")[0].alias("_m")))
        spread = quantiles(join_on(kept, middle, keys).select(*keys, "_m", F.abs(F.col("_d") - F.col("_m")).alias("_a")), [*keys, "_m"], "_a", [0.5])
        reach = F.when(F.col("q")[0] > 0, bound * MAD_TO_SIGMA * F.col("q")[0]).otherwise(F.lit(math.inf))
        new = spread.select(*keys, (F.col("_m") - reach).alias("_from"), (F.col("_m") + reach).alias("_to"))
        if limits is not None:
            both = join_on(new, limits.withColumnsRenamed({"_from": "_f0", "_to": "_t0"}), keys)
            new = both.select(*keys, F.greatest("_from", "_f0").alias("_from"), F.least("_to", "_t0").alias("_to"))
        limits = checkpointed(new)
    kept = join_on(rows, limits, keys).where(F.col("_d").between(F.col("_from"), F.col("_to")))
    return kept.groupBy(*keys).agg((F.var_samp("_d") / 2).alias("var"), F.count("_d").alias("n"))


def pair_points(df: DataFrame, keys: list[str], a: str, b: str, bins: int = 12, least: int = LEAST_PIXELS) -> DataFrame:
    """keys, bin, level, var, n_pix of two frames of one scene: pixels by their mean level in bins of equal ratio from its 1st to its 99.9th
    percentile, median level and clipped half variance of the difference in each. A pair without such a span is one bin (0). Bins with fewer
    than `least` pixels, before or after clipping, have no row."""
    rows = df.select(*keys, finite(a).alias("_a"), finite(b).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL").select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias("_mean"), (F.col("_a") - F.col("_b")).alias("_diff"))
    rows = checkpointed(rows)
    # Tables of one row a group are written, so that they go to the rows and no hot group is sorted for a join.
    span = checkpointed(quantiles(rows, keys, "_mean", [0.01, 0.999]).select(*keys, F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi")))
    spans = (F.col("_lo") > 0) & (F.col("_hi") > F.col("_lo"))
    # The level that the last edge is at belongs to no bin, as levels above it.
    place = F.when(F.col("_mean") >= F.col("_hi"), bins).otherwise(F.floor(F.log(F.col("_mean") / F.col("_lo")) / F.log(F.col("_hi") / F.col("_lo")) * bins))
    where = F.when(~spans, 0).otherwise(F.when(F.col("_mean") >= F.col("_lo"), F.when(place < bins, place + 1)))
    binned = checkpointed(join_on(rows, span, keys).withColumn("bin", where.cast("int")).where("bin IS NOT NULL").select(*keys, "bin", "_mean", "_diff"))
    own = [*keys, "bin"]
    levels = checkpointed(quantiles(binned, own, "_mean", [0.5]).where(F.col("n") >= least).select(*own, F.col("q")[0].alias("level")))
    var = clipped_pair_variance(join_on(binned, levels.select(*own), own), own, "_diff").where(F.col("n") >= least)
    return join_on(levels, var, own).select(*own, "level", "var", F.col("n").alias("n_pix"))


def subframes(apparent, true) -> dict[str, Column]:
    """Sub-frames of an average by the ratio of gains: the ratio, its nearest whole number, and the distance from it."""
    r = safe_div(finite(apparent), finite(true))
    return {"ratio": r, "nsub": F.bround(r).cast("int"), "misfit": F.abs(r - F.bround(r))}


# levels


def find_clip(hist: DataFrame, keys: list[str], level: str, n: str) -> DataFrame:
    """keys, clip, spike_count, tail_level, ratio of merged histograms (keys, level, n): the level with a pile at the top of the dense range, where one
    stands PILE_RATIO times over the valley below it and no more lies above the dense range than in it. Groups without one have no row. Levels that
    are not there count 0."""
    h = hist.groupBy(*keys, F.col(level).cast("long").alias("_a")).agg(F.sum(n).alias("_n")).where("_a IS NOT NULL AND _n > 0")
    top = h.where(F.col("_n") >= DENSE).groupBy(*keys).agg(F.max("_a").alias("_top")).where(F.col("_top") >= LEAST_LEVEL)
    near = join_on(h, top, keys)
    inside = F.col("_a").between(F.greatest(F.lit(0), F.col("_top") - PILE_WINDOW + 1), F.col("_top"))
    peak = near.groupBy(*keys, "_top").agg(F.max(F.when(inside, F.struct("_n", (-F.col("_a")).alias("_b")))).alias("_m"), F.sum(F.when(F.col("_a") > F.col("_top"), F.col("_n")).otherwise(0)).alias("_above"))
    peak = peak.select(*keys, (-F.col("_m._b")).alias("clip"), F.col("_m._n").alias("spike_count"), "_above")
    low = F.greatest(F.lit(0), F.col("clip") - VALLEY_SPAN)
    met = join_on(h, peak, keys).where(F.col("_a").between(low, F.col("clip")))
    valley = met.groupBy(*keys, "clip", "spike_count", "_above").agg(F.min("_n").alias("_min"), F.count(F.lit(1)).alias("_c"))
    tail = F.when(F.col("_c") < F.col("clip") - low + 1, 0).otherwise(F.col("_min")).cast("double")
    out = valley.withColumn("tail_level", tail).withColumn("ratio", F.col("spike_count") / F.greatest("tail_level", F.lit(1.0)))
    return out.where((F.col("ratio") >= PILE_RATIO) & (F.col("_above") <= F.col("spike_count"))).select(*keys, "clip", "spike_count", "tail_level", "ratio")


def ladders(df: DataFrame, keys: list[str], exposure: str, frames: str) -> DataFrame:
    """keys, rungs (sorted exposures), n_rungs, n_frames of groups with enough rungs of enough frames; rows are (keys, exposure, frames), the last of
    equals by frames. A group has no more rungs than there are exposure settings."""
    t = finite(exposure)
    rungs = df.select(*keys, t.alias("_t"), F.col(frames).cast("long").alias("_n")).where("_t > 0").groupBy(*keys, "_t").agg(F.max("_n").alias("_n")).where(F.col("_n") >= LEAST_FRAMES)
    return rungs.groupBy(*keys).agg(F.sort_array(F.collect_list("_t")).alias("rungs"), F.count(F.lit(1)).alias("n_rungs"), F.sum("_n").alias("n_frames")).where(F.col("n_rungs") >= LEAST_RUNGS)


def fit_ladders(df: DataFrame, keys: list[str], exposure: str, flux: str) -> DataFrame:
    """keys, exposure, rate, residual_pct, max_residual_pct, n_rungs: flux = rate * exposure with the median rate, one row a rung. Groups of fewer
    than LEAST_RUNGS usable rungs, or whose rate is not positive, have no row."""
    rows = df.select(*keys, finite(exposure).alias("exposure"), finite(flux).alias("_f")).where("exposure > 0 AND _f IS NOT NULL").withColumn("_rate", F.col("_f") / F.col("exposure"))
    rate = quantiles(rows, keys, "_rate", [0.5]).where((F.col("n") >= LEAST_RUNGS) & (F.col("q")[0] > 0)).select(*keys, F.col("n").alias("n_rungs"), F.col("q")[0].alias("rate"))
    fit = join_on(rows, rate, keys).withColumn("residual_pct", 100 * (F.col("_f") / (F.col("rate") * F.col("exposure")) - 1))
    worst = fit.groupBy(*keys).agg(F.max(F.abs("residual_pct")).alias("max_residual_pct"))
    return join_on(fit, worst, keys).select(*keys, "exposure", "rate", "residual_pct", "max_residual_pct", "n_rungs")


def fair_order(df: DataFrame, mode: str, quality: list[Column], slots: int) -> DataFrame:
    """df with slot: the best of each mode has 0, the second 1, and so on, up to `slots` of each; ordered by slot, then mode, every mode is tried
    before any repeats. Taken from shares first, so that no task orders a mode's rows."""
    shares = df.withColumn("_deal", F.pmod(F.xxhash64(*df.columns), F.lit(32)))
    some = shares.withColumn("_r", F.row_number().over(Window.partitionBy(mode, "_deal").orderBy(*quality))).where(F.col("_r") <= slots).drop("_r", "_deal")
    return some.withColumn("slot", F.row_number().over(Window.partitionBy(mode).orderBy(*quality)) - 1).where(F.col("slot") < slots)


# pointing


def vote_offsets(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, reach: float, cell: float = VOTE_CELL) -> DataFrame:
    """keys, dx, dy, votes: the translation to add to the left positions of each group (frame) to reach the right ones (its reference).

    Offsets of at most `reach` in x and y are voted for in cells; the cell with most votes wins (of equals the least), if it has enough, and
    is refined to the mean of the offsets within a cell's width of its own mean. Pairs are met by squares of the reach, so a star meets those
    within it and no others, and are counted before the shuffle. Groups with fewer than three stars on a side, or no winner, have no row.
    """
    own = lambda d, px, py: d.select(*keys, finite(x).alias(px), finite(y).alias(py)).where(f"{px} IS NOT NULL AND {py} IS NOT NULL")
    a, b = own(left, "_x", "_y"), own(right, "_u", "_v")
    sizes = join_on(a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na")), b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb")), keys).where("_na >= 3 AND _nb >= 3")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    met = a.withColumn("_s", F.explode(steps)).select(*keys, "_x", "_y", (F.floor(F.col("_x") / reach) + F.col("_s.i")).alias("_i"), (F.floor(F.col("_y") / reach) + F.col("_s.j")).alias("_j"))
    pairs = join_on(met, b.select(*keys, "_u", "_v", F.floor(F.col("_u") / reach).alias("_i"), F.floor(F.col("_v") / reach).alias("_j")), [*keys, "_i", "_j"])
    pairs = pairs.select(*keys, (F.col("_u") - F.col("_x")).alias("_dx"), (F.col("_v") - F.col("_y")).alias("_dy")).where((F.abs("_dx") <= reach) & (F.abs("_dy") <= reach))
    cells = pairs.groupBy(*keys, F.floor(F.col("_dx") / cell).alias("_i"), F.floor(F.col("_dy") / cell).alias("_j")).agg(F.count(F.lit(1)).alias("votes"), F.avg("_dx").alias("_cx"), F.avg("_dy").alias("_cy"))
    best = cells.groupBy(*keys).agg(F.max(F.struct("votes", (-F.col("_i")).alias("a"), (-F.col("_j")).alias("b"), "_cx", "_cy")).alias("m")).select(*keys, "m.votes", "m._cx", "m._cy")
    won = join_on(best, sizes, keys).where(F.col("votes") >= F.greatest(F.lit(LEAST_VOTES), VOTE_SHARE * F.least("_na", "_nb")))
    near = join_on(pairs, checkpointed(won), keys).where((F.abs(F.col("_dx") - F.col("_cx")) <= cell) & (F.abs(F.col("_dy") - F.col("_cy")) <= cell))
    return near.groupBy(*keys, "votes").agg(F.avg("_dx").alias("dx"), F.avg("_dy").alias("dy"))


def interleaved(x, y, bits: int) -> Column:
    """Nested cell number of a square of 2 ** bits cells a side: the bits of x and y in turns, so that a cell's children follow each other. bits is 31 at most."""
    out = F.lit(0).cast("long")
    one = lambda c, i: F.shiftright(col(c).cast("long"), i).bitwiseAND(F.lit(1))
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(one(x, i), 2 * i)).bitwiseOR(F.shiftleft(one(y, i), 2 * i + 1))
    return out


def cell_ranges(df: DataFrame, ids: str, shift: int = 35 + 2 * (12 - CELL_LEVEL)) -> DataFrame:
    """first, last: the ranges of ids that hold whole runs of neighbouring cells (ids without their lowest `shift` bits) with an id. A run begins at a
    cell without one before it and ends at one without one after it; beginnings meet their ends in order, slice by slice."""
    cells = checkpointed(df.select(F.shiftright(F.col(ids).cast("long"), shift).alias("c")).where("c IS NOT NULL").distinct())
    one = F.lit(1).alias("one")
    next_to = lambda by: cells.select((F.col("c") + by).alias("c"))
    begins = cells.join(next_to(1), "c", "left_anti").select(one, F.col("c").cast("double").alias("t"), F.col("c").alias("begin"))
    ends = cells.join(next_to(-1), "c", "left_anti").select(one, F.col("c").cast("double").alias("t"), F.col("c").alias("end"))
    runs = asof(begins, ends, ["one"], "t", "t", ["end"], "forward", width=65536.0)
    return runs.select(F.shiftleft("begin", shift).alias("first"), (F.shiftleft(F.col("r_end") + 1, shift) - 1).alias("last"))


def in_ranges(ids, ranges: DataFrame, most: int = 1000) -> Column:
    """A condition that a scan can take: ids in any of the ranges, of which there must be no more than `most`; more raise."""
    found = ranges.orderBy("first").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} ranges: join them instead")
    return reduce(lambda a, b: a | b, [col(ids).between(r["first"], r["last"]) for r in found], F.lit(False))
