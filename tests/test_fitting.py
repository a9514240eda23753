"""Fits by sums against numpy on the rows, and fits of planted truths."""

import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import fitting as L
from seriesforge.operators import robust as R


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.mark.parametrize("intercept", [True, False])
def test_normal_fit_equals_weighted_least_squares(spark, intercept):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, (300, 4)) @ rng.normal(0, 1, (4, 4))
    y, w, key = rng.normal(0, 1, 300) + x @ [1, -2, 0.5, 3], rng.uniform(0.2, 3, 300), rng.integers(0, 3, 300)
    df = frame(spark, k=key, y=y, w=w, **{f"x{i}": x[:, i] for i in range(4)}).repartition(5)
    rows = L.usable(df, ["k"], [f"x{i}" for i in range(4)], "y", "w")
    for r in L.normal_fit(rows, ["k"], 4, intercept).collect():
        at = key == r["k"]
        a = np.column_stack([x[at], *([np.ones(at.sum())] if intercept else [])])
        root = np.sqrt(w[at])
        b = np.linalg.lstsq(a * root[:, None], y[at] * root, rcond=None)[0]
        inverse = np.linalg.inv((a * w[at][:, None]).T @ a)
        assert r["n"] == at.sum() and np.allclose(r["beta"], b[:4], rtol=1e-8)
        assert np.allclose(r["error"], np.sqrt(np.diag(inverse))[:4], rtol=1e-8)
        assert r["rss"] == pytest.approx(np.sum(w[at] * (y[at] - a @ b) ** 2), rel=1e-8)


def test_dependent_regressors_and_few_rows_give_nulls(spark):
    df = frame(spark, k=[1] * 5 + [2] * 2 + [3] * 4, x=[1.0, 2, 3, 4, 5, 1, 2, 7, 7, 7, 7], z=[2.0, 4, 6, 8, 10, 1, 5, 1, 2, 3, 5], y=[1.0, 0, 1, 0, 2, 1, 1, 1, 2, 3, 4])
    found = {r["k"]: r for r in L.normal_fit(L.usable(df, ["k"], ["x", "z"], "y"), ["k"], 2).collect()}
    assert found[1]["beta"][1] is None and found[2]["beta"] is None and found[3]["beta"][0] is None
    planes = {r["k"]: r for r in L.plane_fit(df, ["k"], "x", "z", "y").collect()}
    assert all(p["cx"] is None and p["significance"] is None and not p["significant"] for p in planes.values())


def test_bad_rows_are_left_out_and_a_null_key_is_a_group(spark):
    good = [(None, float(i), 2.0 * i + 1, 1.0) for i in range(6)]
    bad = [(None, float("nan"), 1.0, 1.0), (None, 1.0, float("inf"), 1.0), (None, None, 1.0, 1.0), (None, 1.0, 9.0, 0.0), (None, 1.0, 9.0, -1.0), (None, 1.0, 9.0, None)]
    rows = L.usable(spark.createDataFrame(good + bad, "k string, x double, y double, w double"), ["k"], ["x"], "y", "w")
    r = L.normal_fit(rows, ["k"], 1).collect()
    assert len(r) == 1 and r[0]["n"] == 6 and r[0]["beta"][0] == pytest.approx(2) and r[0]["rss"] == pytest.approx(0, abs=1e-20)


def test_planes(spark):
    rng = np.random.default_rng(9)
    x, y = rng.uniform(0, 4000, (2, 300))
    df = frame(spark, k=["tilt"] * 300 + ["flat"] * 300, x=np.tile(x, 2), y=np.tile(y, 2), z=np.concatenate([0.01 + 2e-6 * x - 1e-6 * y + rng.normal(0, 0.003, 300), rng.normal(0, 0.01, 300)]))
    found = {r["k"]: r for r in L.plane_fit(df, ["k"], "x", "y", "z").collect()}
    assert found["tilt"]["cx"] == pytest.approx(2e-6, rel=0.25) and found["tilt"]["cy"] == pytest.approx(-1e-6, rel=0.4)
    assert found["tilt"]["significant"] and found["tilt"]["swing"] == pytest.approx(3e-6 * 4000, rel=0.35) and not found["flat"]["significant"]


def test_similarity_recovers_rotation_scale_and_shift(spark):
    rng = np.random.default_rng(1)
    src, turn, scale = rng.uniform(0, 2000, (60, 2)), math.radians(2.5), 1.0008
    dst = src @ (scale * np.array([[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]])).T + [13.0, -7.5]
    df = frame(spark, k=1, x=src[:, 0], y=src[:, 1], u=dst[:, 0], v=dst[:, 1])
    fit = L.similarity_fit(df, ["k"], "x", "y", "u", "v")
    r = fit.first()
    assert r["scale"] == pytest.approx(scale, abs=1e-6) and r["rotation_deg"] == pytest.approx(2.5, abs=1e-4) and r["rms"] < 1e-6
    x, y = L.apply_similarity(F.lit(0.0), F.lit(0.0))
    assert tuple(fit.select(x, y).first()) == pytest.approx((13.0, -7.5), abs=1e-6)
    shuffled = frame(spark, k=1, x=src[:, 0], y=src[:, 1], u=rng.uniform(0, 2000, 60), v=rng.uniform(0, 2000, 60))
    assert L.similarity_fit(shuffled, ["k"], "x", "y", "u", "v").first()["rms"] > 100
    one = L.similarity_fit(df.limit(1), ["k"], "x", "y", "u", "v").first()
    assert one["n"] == 1 and one["a"] is None and one["rms"] is None


def test_affine_recovers_a_plate(spark):
    rng = np.random.default_rng(12)
    xi, eta = rng.uniform(-0.3, 0.3, (2, 200))
    m = np.array([[7900.0, -60.0, 2394.0], [55.0, 7900.0, 1597.0]])
    u, v = m @ np.vstack([xi, eta, np.ones(200)])
    r = L.affine_fit(frame(spark, k=1, x=xi, y=eta, u=u, v=v), ["k"], "x", "y", "u", "v").first()
    assert [r[c] for c in "abcdef"] == pytest.approx(m.ravel().tolist(), abs=1e-6) and r["rms"] < 1e-6 and r["n"] == 200
    two = L.affine_fit(frame(spark, k=1, x=xi[:2], y=eta[:2], u=u[:2], v=v[:2]), ["k"], "x", "y", "u", "v").first()
    assert two["a"] is None and two["rms"] is None


def brute_clipped_line(x, y, s, passes=2):
    keep = np.ones(len(x), bool)
    for p in range(passes + 1):
        w = 1 / s[keep] ** 2
        a = np.column_stack([np.ones(keep.sum()), x[keep] - np.median(x)])
        b = np.linalg.lstsq(a * np.sqrt(w)[:, None], y[keep] * np.sqrt(w), rcond=None)[0]
        chi = np.sum(w * (y[keep] - a @ b) ** 2) / (keep.sum() - 2)
        errors = np.sqrt(np.diag(np.linalg.inv((a * w[:, None]).T @ a)) * max(1, chi))
        r = y - b[0] - b[1] * (x - np.median(x))
        mad = 1.4826 * np.median(np.abs(r - np.median(r)))
        if p < passes:
            keep = np.abs(r - np.median(r)) <= 4 * mad
    return keep.sum(), b[0], errors[0], b[1], errors[1], chi


def test_transform_clips_like_the_rows_do(spark):
    rng = np.random.default_rng(8)
    colour, frm = rng.uniform(0.2, 1.5, 250), rng.uniform(14, 18, 250)
    to = frm + 0.01 + 0.06 * (colour - 0.8) + rng.normal(0, 0.02, 250)
    to[:5] += [1, -2, 0.5, 3, 0.3]
    r = L.transform_fit(frame(spark, k=1, a=frm, b=to, c=colour, s=np.full(250, 0.02)), ["k"], "a", "b", "c", "s").first()
    wanted = brute_clipped_line(colour, to - frm, np.full(250, 0.02))
    assert (r["n"], r["a"], r["a_err"], r["b"], r["b_err"], r["chi2nu"]) == pytest.approx(wanted, rel=1e-7)
    assert r["n"] <= 245 and abs(r["b"] - 0.06) < 4 * r["b_err"]


def test_colour_extinction_finds_a_planted_term(spark):
    rng = np.random.default_rng(4)
    colour, airmass = rng.uniform(0.2, 1.4, 30), rng.uniform(1, 2.2, 40)
    s, f = (a.ravel() for a in np.meshgrid(np.arange(30), np.arange(40), indexing="ij"))
    z = (colour[s] - np.median(colour[s])) * (airmass[f] - np.median(airmass[f]))
    for _ in range(12):
        z = z - np.array([z[s == i].mean() for i in range(30)])[s]
        z = z - np.array([z[f == j].mean() for j in range(40)])[f]
    df = frame(spark, k=["term"] * 1200 + ["none"] * 1200, s=np.tile(s, 2), f=np.tile(f, 2), c=np.tile(colour[s], 2), x=np.tile(airmass[f], 2), e=0.01, r=np.concatenate([-0.04 * z + rng.normal(0, 0.01, 1200), rng.normal(0, 0.01, 1200)]))
    found = {r["k"]: r for r in L.colour_extinction(df, ["k"], "r", "e", "c", "x", "s", "f").collect()}
    assert found["term"]["significant"] and abs(found["term"]["kpp"] + 0.04) < 4 * found["term"]["kpp_err"]
    assert not found["none"]["significant"] and found["none"]["n"] + found["none"]["n_clipped"] == 1200
    few = L.colour_extinction(df.where("k = 'term' AND s < 2"), ["k"], "r", "e", "c", "x", "s", "f").first()
    assert few["kpp"] is None and not few["significant"]


def test_harmonics_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    t, y = rng.uniform(0, 30, 90), rng.normal(0, 1, 90)
    y = y + 3 * np.cos(2 * np.pi * (t / 1.7 - 0.3))
    r = L.harmonic_fits(frame(spark, k=1, t=t, y=y), "k", "t", "y", 1.7, 2).first()
    a = 2 * np.pi * t / 1.7
    m = np.column_stack([np.ones(90), np.cos(a), np.sin(a), np.cos(2 * a), np.sin(2 * a)])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    assert (r["n"], r["amplitude"], r["phase"], r["rms"]) == pytest.approx((90, np.hypot(b[1], b[2]), np.arctan2(b[2], b[1]) / (2 * np.pi) % 1, np.sqrt(np.mean((y - m @ b) ** 2))), rel=1e-8)


def test_quantiles_of_hot_groups_equal_numpy(spark):
    rng = np.random.default_rng(6)
    key = np.where(rng.random(5000) < 0.6, "hot", rng.choice(["a", "b", "c"], 5000))
    x = np.where(rng.random(5000) < 0.3, 1.0, np.round(rng.normal(0, 3, 5000), 2))
    df = frame(spark, k=key, x=x).unionByName(spark.createDataFrame([("hot", float("nan")), ("hot", None), ("none", None), (None, 2.0), (None, 4.0)], "k string, x double")).repartition(7)
    found = {r["k"]: (r["n"], r["q"]) for r in R.quantiles(df, ["k"], "x", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    assert set(found) == {"hot", "a", "b", "c", None} and found[None] == (2, pytest.approx([2, 2.1, 3, 3.9, 4]))
    for k in ("hot", "a", "b", "c"):
        assert found[k][0] == (key == k).sum() and found[k][1] == pytest.approx(np.quantile(x[key == k], [0, 0.05, 0.5, 0.95, 1]))
    both = {r["k"]: r for r in R.median_and_mad(df, ["k"], "x").collect()}
    v = x[key == "hot"]
    assert both["hot"]["mad_sigma"] == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v)))) and both["hot"]["n"] == len(v)


def test_no_task_reads_a_whole_hot_group(spark):
    """The ranges of one group's distinct values lie in several partitions."""
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").cast("double").alias("x"))
    ranged = df.groupBy("k", "x").count().repartitionByRange(4, "k", "x").withColumn("p", F.spark_partition_id())
    assert ranged.groupBy("p").count().agg(F.max("count")).first()[0] < 10_000
    assert R.quantiles(df, ["k"], "x", [0.5]).first()["q"] == [9999.5]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, x double, y double, u double, v double, s int, f int")
    assert R.quantiles(df, ["k"], "x", [0.5]).count() == 0 and R.median_and_mad(df, ["k"], "x").count() == 0
    assert L.plane_fit(df, ["k"], "x", "y", "u").count() == 0 and L.affine_fit(df, ["k"], "x", "y", "u", "v").count() == 0
    assert L.similarity_fit(df, ["k"], "x", "y", "u", "v").count() == 0 and L.robust_lines(df, "k", "x", "y").count() == 0
    assert L.transform_fit(df, ["k"], "x", "y", "u").count() == 0 and L.colour_extinction(df, ["k"], "x", "y", "u", "v", "s", "f").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fits_of_hot_groups_sort_and_shuffle_no_rows(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), *[F.rand(i).alias(c) for i, c in enumerate("xyuv")])
    rows.write.mode("overwrite").parquet(path := tempfile.mkdtemp() + "/rows")
    rows = spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20KB")
    try:
        plans = [plan_of(fit(rows, ["g"], "x", "y", "u", "v")) for fit in (L.affine_fit, L.similarity_fit)]
        # One join is left, of two tables with a row for each group: nothing but those is sorted for a join.
        assert all("SortAggregate" not in p and p.count("SortMergeJoin") <= 1 for p in plans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_rows_are_worked_out_once_and_bad_errors_leave_them_out(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", float(i), 2.0 * i + 1, 1.0) for i in range(8)] + [("a", 50.0, 0.0, s) for s in (nan, inf, -1.0, 0.0, None)], "k string, x double, y double, s double")
    rows = L.usable(df, ["k"], ["x"], "y", "s", stored=True)
    assert "isnan" not in rows._jdf.queryExecution().optimizedPlan().toString()
    fit = L.transform_fit(df.select("k", "x", "y", "s", F.lit(0.0).alias("zero")), ["k"], "zero", "y", "x", "s").collect()
    assert [(r.n, round(r.b, 9), r.x_ref) for r in fit] == [(8, 2.0, 3.5)]
