"""Least squares of any number of regressors as sums of products: one aggregate, then a small Cholesky solve as column arithmetic.

Rows never meet in one place: a fit reads its group's sums, which combine before the shuffle, so a group may hold any share of
all rows. What comes back to the rows (means, coefficients) is a written table with one row a group: the planner knows its size and sends
it to the rows; a plan's estimate would be that of the rows, and the join would sort a hot group in one task. Fits that iterate (clipping, Huber weights, two-way centring) keep a table of coefficients, one row a group, which
each round writes anew and joins back to the rows. Rows with NULL or NaN in any value, or a weight that is not positive, are
left out; a group with too few rows or dependent regressors gives NULLs; NULL keys make a group of their own; an empty table
gives an empty one.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.scalars import col, finite, safe_div
from seriesforge.operators.robust import SMALL_GROUP, median_and_mad, quantiles
from seriesforge.sources.tables import checkpointed, join_on

#: Huber's bound in robust sigmas, the bound of clipping, and the significance of a colour-extinction term.
HUBER = 1.345
CLIP = 4.0
SIGNIFICANT_T = 3.0


def usable(df: DataFrame, keys: list[str], xs: list, y, w=None, carry: list[str] = (), stored: bool = False) -> DataFrame:
    """keys, _x0.., _y, _w of the rows that a fit can use. `stored`: as a written table; the values are then worked out once for each row, whereas a
    filter over them would repeat each expression as often as it is named."""
    rows = df.select(*keys, *carry, *[finite(x).alias(f"_x{i}") for i, x in enumerate(xs)], finite(y).alias("_y"), finite(F.lit(1.0) if w is None else w).alias("_w"))
    rows = checkpointed(rows) if stored else rows
    return rows.dropna(subset=[*[f"_x{i}" for i in range(len(xs))], "_y", "_w"]).where("_w > 0")


def solved(sums: DataFrame, k: int, tolerance: float = 1e-11) -> DataFrame:
    """sums (_a{i}{j} for i >= j, _b{i}, _yy) with beta, error (root of the inverse's diagonal) and rss, by a Cholesky factor without roots."""
    out = sums
    a, b = (lambda i, j: F.col(f"_a{max(i, j)}{min(i, j)}")), (lambda i: F.col(f"_b{i}"))
    low, d, z = (lambda i, j: F.col(f"_l{i}{j}")), (lambda i: F.col(f"_d{i}")), (lambda i: F.col(f"_z{i}"))
    for j in range(k):
        pivot = sum((-low(j, m) * low(j, m) * d(m) for m in range(j)), a(j, j))
        out = out.withColumn(f"_d{j}", F.when(pivot > tolerance * a(j, j), pivot))
        out = out.withColumns({f"_l{i}{j}": sum((-low(i, m) * low(j, m) * d(m) for m in range(j)), a(i, j)) / d(j) for i in range(j + 1, k)} | {f"_z{j}": sum((-low(j, m) * z(m) for m in range(j)), b(j))})
    beta, inverse = (lambda i: F.col(f"_beta{i}")), (lambda i, j: F.lit(1.0) if i == j else F.col(f"_m{i}{j}"))
    for j in reversed(range(k)):
        out = out.withColumn(f"_beta{j}", sum((-low(i, j) * beta(i) for i in range(j + 1, k)), z(j) / d(j)))
    for j in range(k):
        for i in range(j + 1, k):
            out = out.withColumn(f"_m{i}{j}", sum((-low(i, m) * inverse(m, j) for m in range(j, i)), F.lit(0.0)))
    error = [F.sqrt(sum((inverse(i, j) * inverse(i, j) / d(i) for i in range(j, k)), F.lit(0.0))) for j in range(k)]
    rss = F.greatest(sum((-z(j) * z(j) / d(j) for j in range(k)), F.col("_yy")), F.lit(0.0))
    return out.withColumns({"beta": F.array(*[beta(j) for j in range(k)]), "error": F.array(*error), "rss": rss})


def normal_fit(rows: DataFrame, keys: list[str], k: int, intercept: bool = True, least: int = 3, extra: dict[str, Column] | None = None) -> DataFrame:
    """keys, n, weight, centre (of the regressors), mean (of y), beta, error, rss of usable() rows, and `extra` aggregates over them.

    With an intercept, all columns are centred on their group's weighted means first, which keeps the sums well conditioned;
    `mean` is then the fitted value at `centre`.
    """
    x, w, y = [F.col(f"_x{i}") for i in range(k)], F.col("_w"), F.col("_y")
    # Numbers only in the aggregates: with an array among them Spark would sort the rows instead of hashing them.
    own = [f"_c{i}" for i in range(k)]
    if intercept:
        means = rows.groupBy(*keys).agg(*[(F.sum(w * c) / F.sum(w)).alias(n) for c, n in zip(x, own)], (F.sum(w * y) / F.sum(w)).alias("_my"))
        rows = join_on(rows, checkpointed(means), keys)
        x, y = [c - F.col(n) for c, n in zip(x, own)], y - F.col("_my")
    centre = [*[F.first(n).alias(n) for n in own], F.first("_my").alias("mean")] if intercept else [*[F.lit(0.0).alias(n) for n in own], F.lit(0.0).alias("mean")]
    products = [F.sum(w * x[i] * x[j]).alias(f"_a{i}{j}") for i in range(k) for j in range(i + 1)] + [F.sum(w * x[i] * y).alias(f"_b{i}") for i in range(k)]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight"), *centre, F.sum(w * y * y).alias("_yy"), *products, *[c.alias(name) for name, c in (extra or {}).items()])
    out = solved(sums, k).withColumn("centre", F.array(*own))
    enough = F.col("n") >= least
    return out.select(*keys, "n", "weight", "centre", "mean", *[F.when(enough, F.col(c)).alias(c) for c in ("beta", "error", "rss")], *(extra or {}))


def predicted(k: int) -> Column:
    """The fitted value of a row that was joined with its group's fit."""
    return sum((F.col("beta")[i] * (F.col(f"_x{i}") - F.col("centre")[i]) for i in range(k)), F.col("mean"))


def plane_fit(df: DataFrame, keys: list[str], x, y, z, least: int = 6, significant: float = 3.0) -> DataFrame:
    """keys, n, c0 (at the mean position), cx, cy, cx_err, cy_err, rms, swing (change from corner to corner), significance, significant."""
    span = lambda c: F.max(c) - F.min(c)
    fit = normal_fit(usable(df, keys, [x, y], z), keys, 2, least=least, extra={"_sx": span("_x0"), "_sy": span("_x1")})
    s = F.sqrt(F.col("rss") / F.greatest(F.col("n") - 3, F.lit(1)))
    b, e = F.col("beta"), F.col("error")
    fit = fit.select(*keys, "n", F.when(b.isNotNull() & b[0].isNotNull(), F.col("mean")).alias("c0"), b[0].alias("cx"), b[1].alias("cy"), (e[0] * s).alias("cx_err"), (e[1] * s).alias("cy_err"), F.sqrt(F.col("rss") / F.col("n")).alias("rms"), (F.abs(b[0]) * F.col("_sx") + F.abs(b[1]) * F.col("_sy")).alias("swing"))
    over = lambda c: F.coalesce(safe_div(F.abs(F.col(c)), F.col(f"{c}_err")), F.lit(0.0))
    rank = F.when(F.col("cx").isNotNull(), F.greatest(over("cx"), over("cy")))
    return fit.withColumn("significance", rank).withColumn("significant", F.coalesce(F.col("significance") >= significant, F.lit(False)))


def position_rms(rows: DataFrame, fit: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """fit with rms, the distance of the mapped positions from the ones wanted (_u, _v), taken from the rows: sums would cancel in a close fit."""
    fit = checkpointed(fit)
    away = join_on(rows, fit, keys).groupBy(*keys).agg(F.sqrt(F.avg((x - F.col("_u")) ** 2 + (y - F.col("_v")) ** 2)).alias("rms"))
    return join_on(fit, away, keys, "left")


def positions(df: DataFrame, keys: list[str], x, y, to_x, to_y) -> DataFrame:
    return df.select(*keys, *[finite(c).alias(n) for c, n in ((x, "_x"), (y, "_y"), (to_x, "_u"), (to_y, "_v"))]).dropna(subset=["_x", "_y", "_u", "_v"])


def affine_fit(df: DataFrame, keys: list[str], x, y, to_x, to_y) -> DataFrame:
    """keys, n, a, b, c, d, e, f, rms of to_x = a x + b y + c, to_y = d x + e y + f; NULLs for fewer than three pairs or pairs on a line."""
    rows = positions(df, keys, x, y, to_x, to_y)
    axis = F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("_u").alias("to")), F.struct(F.lit(1).alias("axis"), F.col("_v").alias("to")))).alias("_t")
    fit = normal_fit(usable(rows.select("*", axis).withColumn("axis", F.col("_t.axis")), [*keys, "axis"], ["_x", "_y"], F.col("_t.to")), [*keys, "axis"], 2)
    b, c = F.col("beta"), F.col("centre")
    row = fit.select(*keys, "axis", "n", b[0].alias("p"), b[1].alias("q"), (F.col("mean") - b[0] * c[0] - b[1] * c[1]).alias("r"))
    at = lambda axis, name: F.max(F.when(F.col("axis") == axis, F.col(name)))
    columns = {"a": (0, "p"), "b": (0, "q"), "c": (0, "r"), "d": (1, "p"), "e": (1, "q"), "f": (1, "r")}
    both = row.groupBy(*keys).agg(F.max("n").alias("n"), *[at(*v).alias(k) for k, v in columns.items()])
    u, v = (F.col(a) * F.col("_x") + F.col(b) * F.col("_y") + F.col(c) for a, b, c in ("abc", "def"))
    return position_rms(rows, both, keys, u, v)


def similarity_fit(df: DataFrame, keys: list[str], x, y, to_x, to_y) -> DataFrame:
    """keys, n, a, b, tx, ty, scale, rotation_deg, rms of to_x = a x - b y + tx, to_y = b x + a y + ty, from variances and covariances; NULLs for
    fewer than two pairs or for pairs at one place."""
    rows = positions(df, keys, x, y, to_x, to_y)
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("_x", "_y", "_u", "_v")], (F.var_pop("_x") + F.var_pop("_y")).alias("_s"),
        (F.covar_pop("_x", "_u") + F.covar_pop("_y", "_v")).alias("_p"), (F.covar_pop("_x", "_v") - F.covar_pop("_y", "_u")).alias("_q"),
    )
    fit = moments.withColumn("a", F.when(F.col("n") >= 2, safe_div(F.col("_p"), F.col("_s")))).withColumn("b", F.when(F.col("n") >= 2, safe_div(F.col("_q"), F.col("_s"))))
    a, b = F.col("a"), F.col("b")
    fit = fit.select(*keys, "n", "a", "b", (F.col("m_u") - a * F.col("m_x") + b * F.col("m_y")).alias("tx"), (F.col("m_v") - b * F.col("m_x") - a * F.col("m_y")).alias("ty"), F.hypot("a", "b").alias("scale"), F.degrees(F.atan2("b", "a")).alias("rotation_deg"))
    return position_rms(rows, fit, keys, *apply_similarity("_x", "_y"))


def apply_similarity(x, y) -> tuple[Column, Column]:
    """A position mapped by the columns a, b, tx, ty of a similarity_fit."""
    return F.col("a") * col(x) - F.col("b") * col(y) + F.col("tx"), F.col("b") * col(x) + F.col("a") * col(y) + F.col("ty")


def refitted(rows: DataFrame, keys: list[str], k: int, weight: Callable[[Column, Column, Column], Column], rounds: int, intercept: bool = True, least: int = 3, extra: dict[str, Column] | None = None) -> DataFrame:
    """normal_fit of usable() rows, then `rounds` more, each with the weights that `weight` makes of a row's residual about the last fit and
    the median and robust sigma of its group's residuals. Stops as soon as no coefficient moves. Each round's coefficients are a written table."""
    fit = checkpointed(normal_fit(rows, keys, k, intercept, least, extra))
    small = (fit.agg(F.max("n")).first()[0] or 0) <= SMALL_GROUP
    for _ in range(rounds):
        about = join_on(rows, fit.select(*keys, "beta", "centre", "mean"), keys).withColumn("_r", F.col("_y") - predicted(k))
        scale = checkpointed(median_and_mad(about, keys, "_r", small))
        again = join_on(about.drop("beta", "centre", "mean"), scale.select(*keys, "median", "mad_sigma"), keys)
        again = again.withColumn("_w", F.col("_w") * weight(F.col("_r"), F.col("median"), F.col("mad_sigma"))).where("_w > 0").drop("_r", "median", "mad_sigma")
        new = checkpointed(normal_fit(again, keys, k, intercept, least, extra))
        moved = join_on(fit.select(*keys, F.col("beta").alias("_old")), new.select(*keys, "beta"), keys).where(F.exists(F.arrays_zip("_old", "beta"), lambda p: ~(F.abs(p["_old"] - p["beta"]) <= 1e-12 + 1e-10 * F.abs(p["beta"])))).limit(1).count()
        fit = new
        if not moved:
            break
    return fit


def clip_weight(residual: Column, middle: Column, sigma: Column, bound: float = CLIP) -> Column:
    """1 within the bound, 0 beyond; a group without scatter keeps all."""
    return F.when((F.abs(residual - middle) <= bound * sigma) | (F.coalesce(sigma, F.lit(0.0)) <= 0), 1.0).otherwise(0.0)


def huber_weight(residual: Column, middle: Column, sigma: Column, bound: float = HUBER) -> Column:
    u = F.abs(residual) / (bound * sigma)
    return F.when((F.coalesce(sigma, F.lit(0.0)) <= 0) | (u <= 1), 1.0).otherwise(1 / u)


def transform_fit(df: DataFrame, keys: list[str], mag_from, mag_to, colour, sigma=None, passes: int = 2) -> DataFrame:
    """keys, n, a, a_err, b, b_err, x_ref, rms, chi2nu of mag_to - mag_from = a + b (colour - x_ref), x_ref the group's median colour;
    after each pass rows beyond 4 robust sigmas go. Errors grow by the root of chi2nu where it is over 1."""
    error = F.lit(1.0) if sigma is None else col(sigma).cast("double")
    # A NaN or an infinite error gives NaN or 0 here, which usable() leaves out.
    rows = usable(df, keys, [colour], col(mag_to) - col(mag_from), F.when(error > 0, 1 / (error * error)), stored=True)
    ref = quantiles(rows, keys, "_x0", [0.5]).select(*keys, F.col("q")[0].alias("x_ref"))
    fit = join_on(refitted(rows, keys, 1, clip_weight, passes), ref, keys)
    chi = F.col("rss") / F.greatest(F.col("n") - 2, F.lit(1))
    grown = F.sqrt(F.greatest(chi, F.lit(1.0)))
    away = F.col("x_ref") - F.col("centre")[0]
    b, e = F.col("beta")[0], F.col("error")[0]
    return fit.select(*keys, "n", F.when(b.isNotNull(), F.col("mean") + b * away).alias("a"), (F.sqrt(1 / F.col("weight") + away * away * e * e) * grown).alias("a_err"), b.alias("b"), (e * grown).alias("b_err"), "x_ref", chi.alias("chi2nu"))


def robust_lines(df: DataFrame, key: str, x: str, y: str, rounds: int = 30) -> DataFrame:
    """key, n, slope, intercept of lines with Huber weights on residuals in robust sigmas; NULLs for fewer than three rows or one x."""
    fit = refitted(usable(df, [key], [x], y, stored=True), [key], 1, huber_weight, rounds)
    b = F.col("beta")[0]
    return fit.select(key, "n", b.alias("slope"), (F.col("mean") - b * F.col("centre")[0]).alias("intercept"))


def harmonic_fits(df: DataFrame, key: str, t: str, y: str, period: float, orders: int = 2) -> DataFrame:
    """key, n, amplitude and phase (cycles) of the first harmonic, residual rms of a Fourier fit of `orders` at a known period."""
    a = 2 * F.pi() * finite(t) / period
    xs = [f(k * a) for k in range(1, orders + 1) for f in (F.cos, F.sin)]
    fit = normal_fit(usable(df, [key], xs, y), [key], 2 * orders, least=2 * orders + 2)
    b = F.col("beta")
    turn = F.atan2(b[1], b[0]) / (2 * F.pi())
    return fit.select(key, "n", F.hypot(b[0], b[1]).alias("amplitude"), (turn - F.floor(turn)).alias("phase"), F.when(b[0].isNotNull(), F.sqrt(F.col("rss") / F.col("n"))).alias("rms"))


def two_way_centred(rows: DataFrame, keys: list[str], a: str, b: str, x: str, sweeps: int = 4) -> DataFrame:
    """rows (stored) with x less the effects of a and b, fitted in turns within each of the keys' groups. A sweep makes the effects anew, one row
    for each a and each b, and writes them; the rows are read, never rewritten."""
    zero = lambda c: rows.groupBy(*keys, c).agg(F.lit(0.0).alias("_e"))
    effects = {a: None, b: zero(b)}
    for _ in range(sweeps):
        for own, other in ((a, b), (b, a)):
            with_other = join_on(rows, effects[other], [*keys, other])
            effects[own] = checkpointed(with_other.groupBy(*keys, own).agg(F.avg(F.col(x) - F.col("_e")).alias("_e")))
    both = join_on(join_on(rows, effects[a], [*keys, a]).withColumnRenamed("_e", "_ea"), effects[b], [*keys, b])
    return both.withColumn(x, F.col(x) - F.col("_ea") - F.col("_e")).drop("_ea", "_e")


def colour_extinction(df: DataFrame, keys: list[str], residual, sigma, colour, airmass, star: str, frame: str, passes: int = 2, sweeps: int = 4, least: int = 20) -> DataFrame:
    """keys, n, n_clipped, kpp, kpp_err, t_stat, significant, chi2nu, colour_ref, airmass_ref of residual = kpp (colour - ref)(airmass - ref), the
    product less its star and frame effects, as the residual is. One parameter, no intercept; after each pass rows beyond 4 robust
    sigmas go; the error grows by the root of chi2nu where it is over 1. NULLs for fewer than `least` rows or three stars or frames."""
    s = finite(sigma)
    rows = df.select(*keys, F.col(star).alias("_star"), F.col(frame).alias("_frame"), finite(residual).alias("_y"), F.when(s > 0, 1 / (s * s)).alias("_w"), finite(colour).alias("_c"), finite(airmass).alias("_a")).dropna(subset=["_y", "_w", "_c", "_a"])
    refs = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("_star").alias("_ns"), F.count_distinct("_frame").alias("_nf"))
    for c, name in (("_c", "colour_ref"), ("_a", "airmass_ref")):
        refs = join_on(refs, quantiles(rows, keys, c, [0.5]).select(*keys, F.col("q")[0].alias(name)), keys)
    refs = checkpointed(refs)
    product = join_on(rows, refs.select(*keys, "colour_ref", "airmass_ref"), keys).withColumn("_x0", (F.col("_c") - F.col("colour_ref")) * (F.col("_a") - F.col("airmass_ref")))
    base = checkpointed(two_way_centred(checkpointed(product.select(*keys, "_star", "_frame", "_x0", "_y", "_w")), keys, "_star", "_frame", "_x0", sweeps))
    fit = join_on(refitted(base, keys, 1, clip_weight, passes, intercept=False, least=least), refs, keys)
    ok = (F.col("_n") >= least) & (F.col("_ns") >= 3) & (F.col("_nf") >= 3)
    chi = F.col("rss") / F.greatest(F.col("n") - 1, F.lit(1))
    out = fit.select(*keys, "n", (F.col("_n") - F.col("n")).alias("n_clipped"), F.when(ok, F.col("beta")[0]).alias("kpp"), F.when(ok, F.col("error")[0] * F.sqrt(F.greatest(chi, F.lit(1.0)))).alias("kpp_err"), F.when(ok, chi).alias("chi2nu"), "colour_ref", "airmass_ref")
    t = safe_div(F.col("kpp"), F.col("kpp_err"))
    return out.withColumn("t_stat", t).withColumn("significant", F.coalesce(F.abs(t) >= SIGNIFICANT_T, F.lit(False)))


def bound_mmag(error, colour_span, airmass_span, t: float = SIGNIFICANT_T) -> Column:
    """What leaving the term out can cost at most, in thousandths of a magnitude."""
    return 1000 * t * col(error) * F.abs(col(colour_span)) / 2 * F.abs(col(airmass_span)) / 2
