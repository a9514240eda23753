"""Tolerance, nearest, as-of and ladder joins, none of them a cross join.

Nearest-in-time joins go by union and window: both sides in one ordering per key and time slice, each left row
takes the last right row before it and the first one after it. So no task holds all rows of a hot key; what lies
beyond the ends of a slice comes from a table with one row for each slice.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import col, separation_deg
from seriesforge.sources.tables import checkpointed, join_on

#: Joins on cells: rows of a side in one share of a cell, pairs that a task compares on average, most tasks.
BLOCK, TASK_PAIRS, MOST_TASKS = 2048, 1 << 24, 20_000


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, carry: list[str], how: str = "nearest", strict: bool = False, width: float = 30 * 86400.0) -> DataFrame:
    """left with r_<column> of the right row before ('backward'), after ('forward') or nearest to it in time.

    Equal distances go to the earlier row; of right rows with the same time the one with the least carry
    columns counts. strict leaves out right rows at the same time. Left rows without a partner have NULLs,
    and so have those with a NULL time. `width` is the length of a time slice, in the unit that the times have as numbers.
    """
    number = lambda c: F.col(c).cast("timestamp").cast("double") if "timestamp" in kind else F.col(c).cast("double")
    kind = right.schema[right_time].dataType.simpleString()
    value = "struct<t:" + kind + "".join(f",c_{c}:{right.schema[c].dataType.simpleString()}" for c in carry) + ">"
    one = right.where(F.col(right_time).isNotNull()).groupBy(*by, right_time).agg(F.min(F.struct(*[F.col(c).alias(f"c_{c}") for c in carry])).alias("_c"))
    points = one.select(*by, number(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(blank_type(left)).alias("_l"), F.struct(F.col(right_time).alias("t"), *[F.col(f"_c.c_{c}") for c in carry]).cast(value).alias("_r"))
    queries = left.select(*by, number(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.lit(None).cast(value).alias("_r"))
    stacked = queries.unionByName(points).withColumn("_slice", F.floor(F.col("_t") / width))
    own = [*by, "_slice"]
    # A right row at the same time comes before a left one, unless it must not count.
    w = Window.partitionBy(*own).orderBy("_t", F.col("_side") * (-1 if strict else 1))
    w_after = Window.partitionBy(*own).orderBy("_t", F.col("_side") * (1 if strict else -1))
    before = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_r", ignorenulls=True).over(w_after.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # From beyond the slice: a row for each slice says what it ends and begins with.
    edges = stacked.groupBy(*own).agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col("_t"))).alias("_e"), F.min_by("_r", F.when(F.col("_side") == 0, F.col("_t"))).alias("_f"))
    wide = Window.partitionBy(*by).orderBy("_slice")
    edges = edges.select(
        *[F.col(c).alias(f"_k_{c}") for c in own],
        F.last("_e", ignorenulls=True).over(wide.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_f", ignorenulls=True).over(wide.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    on = F.lit(True)
    for c in own:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    seen = stacked.withColumn("_b", before).withColumn("_a", after).where("_side = 1").join(edges, on)
    seen = seen.withColumn("_b", F.coalesce("_b", "_before")).withColumn("_a", F.coalesce("_a", "_after"))
    gap = lambda x: F.abs((F.col(f"{x}.t").cast("timestamp").cast("double") if "timestamp" in kind else F.col(f"{x}.t").cast("double")) - F.col("_t"))
    chosen = {
        "backward": F.col("_b"),
        "forward": F.col("_a"),
        "nearest": F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | (gap("_b") <= gap("_a")), F.col("_b")).otherwise(F.col("_a")),
    }[how]
    out = seen.withColumn("_m", F.when(F.col("_t").isNotNull(), chosen))
    return out.select("_l.*", F.col("_m.t").alias(f"r_{right_time}"), *[F.col(f"_m.c_{c}").alias(f"r_{c}") for c in carry])


def blank_type(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema) + ">"


def cell_join(left: DataFrame, right: DataFrame, cells: list[str], block: int = BLOCK, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """An equi-join on cells, all pairs of a cell, dealt out by the pairs it makes and not by the bytes it reads.

    A cell with more than `block` rows on a side is cut into shares of about that many, each of which meets every share of the other side, so no
    task holds a whole hot cell on either side; its rows are repeated once for each share of the other side. Cells are counted first.
    """
    count = lambda df, n: df.groupBy(*cells).agg(F.count(F.lit(1)).alias(n))
    met = checkpointed(count(left, "_n_l").join(count(right, "_n_r"), cells))
    pairs = met.agg(F.sum(F.col("_n_l").cast("double") * F.col("_n_r"))).first()[0] or 0.0
    shares = met.select(*cells, F.ceil(F.col("_n_l") / block).cast("int").alias("_k_l"), F.ceil(F.col("_n_r") / block).cast("int").alias("_k_r")).where("_k_l > 1 OR _k_r > 1")
    tasks = int(min(MOST_TASKS, max(1, math.ceil(pairs / task_pairs))))
    # No more hot cells than there are blocks of rows; a written list has a size that the planner knows.
    shares = checkpointed(shares)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*df.columns), F.coalesce(f"_k{own}", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(f"_k{other}", F.lit(1)) - 1))
        rows = df.join(shares, cells, "left").select(*df.columns, mine.alias(f"_s{own}"), "_k_l", "_k_r").select(*df.columns, f"_s{own}", every.alias(f"_s{other}"))
        return rows.repartition(tasks, *cells, "_s_l", "_s_r")

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [*cells, "_s_l", "_s_r"]).drop("_s_l", "_s_r")


def range_join(left: DataFrame, right: DataFrame, left_x: str, right_x: str, tol: float, by: list[str] | None = None) -> DataFrame:
    """Pairs with |left_x - right_x| <= tol, as an equi-join on cells of width tol: a left row meets three cells."""
    by = by or []
    cells = F.explode(F.array(*[F.floor(F.col(left_x) / tol) + i for i in (-1, 0, 1)]))
    a = left.withColumn("_cell", cells)
    b = right.withColumn("_cell", F.floor(F.col(right_x) / tol))
    return cell_join(a, b, ["_cell", *by]).where(F.abs(F.col(left_x) - F.col(right_x)) <= tol).drop("_cell")


def plane_join(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, tol: float) -> DataFrame:
    """Pairs within distance tol of a plane, by square cells; adds dist."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.withColumn("_s", F.explode(steps)).withColumn("_i", F.floor(F.col(lx) / tol) + F.col("_s.i")).withColumn("_j", F.floor(F.col(ly) / tol) + F.col("_s.j")).drop("_s")
    b = right.withColumn("_i", F.floor(F.col(rx) / tol)).withColumn("_j", F.floor(F.col(ry) / tol))
    return cell_join(a, b, ["_i", "_j"]).withColumn("dist", F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry))).where(F.col("dist") <= tol).drop("_i", "_j")


def nearest_two(pairs: DataFrame, key: str, order: list[str], carry: str, dist: str = "dist") -> DataFrame:
    """key, nearest, dist1, dist2 (NULL if there is no second one). Two minima, no sort of a group."""
    first = pairs.groupBy(key).agg(F.min_by(F.struct(F.col(carry).alias("c"), F.col(dist).alias("d")), F.struct(dist, *order)).alias("one"))
    second = pairs.join(first, key).where(F.col(carry) != F.col("one.c")).groupBy(key).agg(F.min(dist).alias("dist2"))
    return first.join(second, key, "left").select(key, F.col("one.c").alias("nearest"), F.col("one.d").alias("dist1"), "dist2")


def ladder(left: DataFrame, key: str, rungs: list[tuple[str, DataFrame]]) -> DataFrame:
    """key, rung, partner: each left row takes the first rung that offers it a partner (the least one), or 'orphan'.

    rungs: name and the pairs (key, partner) it offers. The choice is a minimum over (rung, partner).
    """
    offers = None
    for i, (name, pairs) in enumerate(rungs):
        o = pairs.select(key, F.struct(F.lit(i).alias("i"), F.lit(name).alias("rung"), F.col("partner").alias("partner")).alias("o"))
        offers = o if offers is None else offers.unionByName(o)
    best = offers.groupBy(key).agg(F.min("o").alias("o"))
    return left.select(key).join(best, key, "left").select(key, F.coalesce("o.rung", F.lit("orphan")).alias("rung"), F.col("o.partner").alias("partner"))


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, change: appeared, destroyed, content or same, of two keyed tables; NULL keys are equal. One aggregate over both."""
    both = before.select(*keys, F.struct(*values).alias("_a"), F.lit(None).cast(before.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_b"), F.lit(0).alias("_side"))
    both = both.unionByName(after.select(*keys, F.lit(None).cast(before.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_a"), F.struct(*values).alias("_b"), F.lit(1).alias("_side")))
    seen = both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.min("_side").alias("_first"), F.max("_side").alias("_last"))
    change = F.when(F.col("_first") == 1, "appeared").when(F.col("_last") == 0, "destroyed").when(~F.col("_a").eqNullSafe(F.col("_b")), "content").otherwise("same")
    return seen.select(*keys, change.alias("change"))


def cone_join(left: DataFrame, right: DataFrame, lra: str, ldec: str, rra: str, rdec: str, tol_deg: float) -> DataFrame:
    """Pairs within an angle on the sphere, at the poles and over 0/360 too; adds sep in degrees. NULL coordinates match nothing.

    Cells are cubes of the unit sphere as wide as the chord of the angle, so a left row meets its own cell and the 26 around it.
    """
    chord = 2 * math.sin(math.radians(min(tol_deg, 180.0)) / 2)
    wide = max(chord * (1 + 1e-9), 1e-9)

    def cell(ra: str, dec: str) -> list[Column]:
        a, d = F.radians(F.col(ra)), F.radians(F.col(dec))
        return [F.floor(x / wide) for x in (F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))]

    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    near = left.where(F.col(lra).isNotNull() & F.col(ldec).isNotNull()).withColumn("_s", F.explode(steps))
    near = near.select("*", *[(x + F.col(f"_s.{n}")).alias(f"_{n}") for n, x in zip("ijk", cell(lra, ldec))]).drop("_s")
    other = right.where(F.col(rra).isNotNull() & F.col(rdec).isNotNull()).select("*", *[x.alias(f"_{n}") for n, x in zip("ijk", cell(rra, rdec))])
    met = cell_join(near, other, ["_i", "_j", "_k"]).drop("_i", "_j", "_k")
    return met.withColumn("sep", separation_deg(lra, ldec, rra, rdec)).where(F.col("sep") <= tol_deg)


def reconcile(measured: DataFrame, claims: DataFrame, keys: list[str], value: str, claim: str) -> DataFrame:
    """keys, value, claim, diff, status for every claim; what was not measured is 0."""
    found = F.coalesce(F.col(value), F.lit(0))
    return claims.join(measured, keys, "left").select(*keys, found.alias(value), claim, (found - F.col(claim)).alias("diff"), F.when(found == F.col(claim), "HOLDS").otherwise("VIOLATED").alias("status"))


def coverage(df: DataFrame, rows: list[str], needs: dict[str, Column], enough: int = 1) -> DataFrame:
    """rows, need, n, status: for each group and named predicate how many rows meet it: ok, partial or missing."""
    counted = df.groupBy(*rows).agg(*[F.count_if(p).alias(n) for n, p in needs.items()])
    long = counted.select(*rows, F.explode(F.array(*[F.struct(F.lit(n).alias("need"), F.col(n).alias("n")) for n in needs])).alias("c")).select(*rows, "c.*")
    return long.withColumn("status", F.when(col("n") >= enough, "ok").when(col("n") > 0, "partial").otherwise("missing"))


def greedy_pairs(pairs: DataFrame, group: str, a: str, b: str, dist: str) -> DataFrame:
    """group, a, b, dist: pairs taken by increasing distance (ties by a, then b), each id once in its group.

    In rounds: a pair that is the least of both its ends is one that the greedy order takes, whatever else there is. Each round
    takes all of these and drops the pairs of their ends, so a round is two aggregates, and what is left is written.
    """
    left = checkpointed(pairs.select(group, a, b, F.col(dist).cast("double").alias(dist)).dropna(subset=[a, b, dist]))
    best = F.min(F.struct(dist, a, b)).alias("m")
    taken: list[DataFrame] = []
    while True:
        of_a, of_b = left.groupBy(group, a).agg(best), left.groupBy(group, b).agg(best)
        mutual = join_on(of_a.select(group, F.col(f"m.{a}").alias(a), F.col(f"m.{b}").alias(b), F.col(f"m.{dist}").alias(dist)), of_b.select(group, b, F.col(f"m.{a}").alias("_a"), F.col(f"m.{dist}").alias("_d")), [group, b])
        mutual = checkpointed(mutual.where((F.col(a) == F.col("_a")) & (F.col(dist) == F.col("_d"))).drop("_a", "_d"))
        if mutual.isEmpty():
            break
        taken.append(mutual)
        gone = lambda c: mutual.select(group, c, F.lit(True).alias("_gone"))  # noqa: B023, E731
        for c in (a, b):
            left = join_on(left, gone(c), [group, c], "left").where("_gone IS NULL").drop("_gone")
        left = checkpointed(left)
    return reduce(DataFrame.unionByName, taken, mutual.limit(0))
