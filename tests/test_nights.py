"""Night-projected periods, bootstraps on sums, ensembles and comparison stars against numpy on the rows."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import ensemble as E
from seriesforge.operators import joins as J
from seriesforge.operators import periods as P
from seriesforge.operators.series import refine_peak

FLOOR = 0.005


def series(seed=3, nights=9, f=12.6, offsets=0.0):
    rng = np.random.default_rng(seed)
    t = np.concatenate([np.sort(rng.uniform(0, 0.3, 40)) + d for d in np.cumsum(rng.integers(1, 4, nights))])
    night = np.repeat(np.arange(nights), 40)
    y = 0.3 * np.sin(2 * np.pi * f * t) + rng.normal(0, 0.03, len(t)) + offsets * rng.normal(0, 1, nights)[night]
    return pd.DataFrame({"star": "a", "night": night, "t": t, "y": y, "w": 1 / rng.uniform(0.02, 0.05, len(t)) ** 2})


def with_dummies(d, f):
    """chi square of night constants alone and with a sinusoid, by least squares on dummy columns."""
    w, one = np.sqrt(d.w.to_numpy()), pd.get_dummies(d.night).to_numpy(float)
    out = []
    for extra in ([], [np.cos(2 * np.pi * f * d.t), np.sin(2 * np.pi * f * d.t)]):
        a = np.column_stack([one, *extra]) * w[:, None]
        b = np.linalg.lstsq(a, d.y * w, rcond=None)[0]
        out.append((np.sum((d.y * w - a @ b) ** 2), b))
    return 1 - out[1][0] / out[0][0], np.hypot(*out[1][1][-2:])


def test_power_equals_the_fit_with_a_column_a_night(spark):
    d = series(offsets=0.4)
    grid = P.power_of(P.night_sums(spark.createDataFrame(d).repartition(5), ["star"], "night", "t", "y", "w", 12.0, 13.2, 13), ["star"], 12.0, 13.2, 13).collect()
    assert len(grid) == 13
    for r in grid:
        power, amplitude = with_dummies(d, r["f"])
        assert r["power"] == pytest.approx(power, abs=1e-9) and r["amplitude"] == pytest.approx(amplitude, rel=1e-6)


def test_offsets_of_nights_do_not_move_the_power(spark):
    a, b = series(), series()
    b["y"] += np.random.default_rng(7).normal(0, 0.4, 9)[b.night]
    p = [P.power_of(P.night_sums(spark.createDataFrame(d), ["star"], "night", "t", "y", "w", 12.0, 13.5, 40), ["star"], 12.0, 13.5, 40).orderBy("k").toPandas().sort_values("f").power for d in (a, b)]
    assert np.allclose(*p, atol=1e-9)
    best = refine_peak(P.power_of(P.night_sums(spark.createDataFrame(a), ["star"], "night", "t", "y", "w", 12.5, 12.7, 201), ["star"], 12.5, 12.7, 201), ["star"], 0.001).first()
    assert best["f"] == pytest.approx(12.6, rel=1e-3)


def test_draws_are_hashes_and_do_not_depend_on_partitions(spark):
    nights = spark.createDataFrame([("a", n) for n in range(7)] + [("b", n) for n in range(2)] + [(None, 5)], "k string, night int")
    found = {(r["k"], r["night"], r["rep"]): r["times"] for r in P.multiplicities(nights.repartition(3), ["k"], "night", 6).collect()}
    assert found == {(r["k"], r["night"], r["rep"]): r["times"] for r in P.multiplicities(nights.coalesce(1), ["k"], "night", 6).collect()}
    for k, n in (("a", 7), ("b", 2)):
        for rep in range(6):
            picks = [int(hashlib.md5(f"0|{k}|{rep}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
            assert {i: picks.count(i) for i in set(picks)} == {night: v for (a, night, b), v in found.items() if (a, b) == (k, rep)}


def test_bootstrapped_period_brackets_the_truth_and_equals_rows_drawn_anew(spark):
    d = series()
    df = spark.createDataFrame(d)
    sums = P.night_sums(df, ["star"], "night", "t", "y", "w", 12.57, 12.63, 61).cache()
    r = P.bootstrapped_period(sums, ["star"], "night", 12.57, 12.63, 61, 40).first()
    assert r["replicates"] == 40 and r["sigma"] > 0 and abs(r["period"] - 1 / 12.6) < 5 * r["sigma"]
    times = {x["night"]: x["times"] for x in P.multiplicities(df.select("star", "night").distinct(), ["star"], "night", 1).collect()}
    drawn = pd.concat([d[d.night == n].assign(night=100 * n + i) for n, m in times.items() for i in range(m)])
    again = {x["k"]: x["power"] for x in P.power_of(sums.join(spark.createDataFrame(list(times.items()), "night long, times long"), "night").withColumn("rep", F.lit(0)), ["rep"], 12.57, 12.63, 61, F.col("times")).collect()}
    for k in (0, 30, 60):
        assert again[k] == pytest.approx(with_dummies(drawn, 12.57 + k * 0.001)[0], abs=1e-9)
    assert P.bootstrapped_period(sums.where("night < 2"), ["star"], "night", 12.57, 12.63, 61, 10).first()["sigma"] is None


def test_bootstrapped_threshold_and_ratio(spark):
    rng = np.random.default_rng(8)
    d = pd.DataFrame({"k": "a", "night": np.arange(100) % 25, "v": np.concatenate([rng.normal(15, 0.1, 60), rng.normal(18, 0.1, 40)])})
    r = P.bootstrapped_threshold(spark.createDataFrame(d), ["k"], "night", "v", 80).first()
    assert r["replicates"] == 80 and 15.3 < r["threshold"] < 17.7 and r["sigma"] < 0.6
    assert P.bootstrapped_threshold(spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0)], "k string, night int, v double"), ["k"], "night", "v", 5).count() == 0
    star = pd.DataFrame({"k": "a", "s": np.repeat(np.arange(50), 20), "z": rng.normal(0, 1, 1000)})
    star["y"] = 2 * star.z + rng.normal(0, 0.1, 1000) + (rng.normal(0, 0.5, 50)[star.s] * star.z)
    q = P.bootstrapped_ratio(spark.createDataFrame(star), ["k"], "s", F.col("z") * F.col("y"), F.col("z") * F.col("z"), 60).first()
    assert q["units"] == 50 and abs(q["ratio"] - 2) < 4 * q["sigma"] and 0.03 < q["sigma"] < 0.2
    assert P.bootstrapped_ratio(spark.createDataFrame(star[star.s < 5]), ["k"], "s", F.col("z"), F.col("z") * F.col("z"), 10).first()["sigma"] is None


# ---- ensembles


def brute_solution(star, frame, mag, sigma, clip=4.0, passes=2, rounds=200):
    w = 1 / (sigma**2 + FLOOR**2)
    keep = np.isfinite(mag)
    ns, nf = star.max() + 1, frame.max() + 1
    z = np.zeros(nf)
    for p in range(passes + 1):
        s, f, y, v = star[keep], frame[keep], mag[keep], w[keep]
        for _ in range(rounds):
            m = np.bincount(s, v * (y - z[f]), ns) / np.bincount(s, v, ns)
            new = np.bincount(f, v * (y - m[s]), nf) / np.bincount(f, v, nf)
            new -= new.mean()
            moved, z = np.abs(new - z).max(), new
            if moved < 1e-12:
                break
        m = np.bincount(s, v * (y - z[f]), ns) / np.bincount(s, v, ns)
        r = np.abs(mag - m[star] - z[frame])
        inside = keep & (r <= clip * np.sqrt(np.mean(r[keep] ** 2)))
        if p == passes or inside.sum() == keep.sum():
            break
        keep = inside
    return m, z


def night(seed=5, stars=20, frames=30, holes=0.15):
    rng = np.random.default_rng(seed)
    m, z = rng.normal(15, 1, stars), rng.normal(0, 0.3, frames)
    s, f = (a.ravel() for a in np.meshgrid(np.arange(stars), np.arange(frames), indexing="ij"))
    d = pd.DataFrame({"k": "s", "star": s, "frame": f, "mag": m[s] + z[f] + rng.normal(0, 0.005, len(s)), "sigma": rng.uniform(0.004, 0.01, len(s))})
    return d[rng.random(len(d)) > holes].reset_index(drop=True), m, z


def test_ensemble_equals_the_matrix_solution(spark):
    d, _, _ = night()
    d.loc[7, "mag"] += 3
    got = {(r["kind"], int(r["id"])): r["value"] for r in E.ensembles(spark.createDataFrame(d).repartition(4), "k", "star", "frame", "mag", "sigma").collect()}
    m, z = brute_solution(d.star.to_numpy(), d.frame.to_numpy(), d.mag.to_numpy(), d.sigma.to_numpy())
    assert np.allclose([got["star", i] for i in range(20)], m, atol=1e-8) and np.allclose([got["frame", j] for j in range(30)], z, atol=1e-8)


def brute_roles(d, target, checks=4):
    frames = d.frame.nunique()
    seen = d.groupby("star").frame.nunique()
    candidate = {s for s in seen.index if seen[s] >= 0.5 * frames and s != target}
    comp = set(candidate)
    for _ in range(10):
        left = d[d.star.isin(comp)]
        s, f = pd.factorize(left.star, sort=True), pd.factorize(left.frame, sort=True)
        m, z = brute_solution(s[0], f[0], left.mag.to_numpy(), left.sigma.to_numpy(), passes=0)
        rms = left.assign(r=(left.mag - m[s[0]] - z[f[0]]) ** 2).groupby("star").r.mean() ** 0.5
        if len(comp) < 5:
            break
        stays = set(rms.index[rms <= max(2.5 * rms.median(), 0.02)])
        if len(stays) < 5:
            stays = set(rms.sort_values(kind="stable").index[:5])
        if stays == comp:
            break
        comp = stays
    median = d.groupby("star").mag.median()
    anchor = median[target] if target in median else median[list(comp)].median()
    near = sorted(comp, key=lambda s: (abs(median[s] - anchor), s))[: min(checks, max(0, len(comp) - 5))]
    return {s: "target" if s == target else "check" if s in near else "comp" if s in comp else "dropped_unstable" if s in candidate else "field" for s in seen.index}


def test_comparison_stars_equal_the_matrix_version(spark):
    d, _, z = night(seed=11, stars=24, frames=40, holes=0.05)
    d.loc[d.star == 7, "mag"] += 0.4 * np.sin(np.linspace(0, 19, (d.star == 7).sum()))
    d.loc[d.star == 9, "mag"] += 0.1 * np.sin(np.linspace(0, 11, (d.star == 9).sum()))
    d = d[~((d.star == 13) & (d.frame > 2))]
    found = {r["star"]: r["role"] for r in E.comparison_stars(spark.createDataFrame(d), "k", "star", "frame", "mag", "sigma", is_target=F.col("star") == 0).collect()}
    assert found == brute_roles(d, 0)
    assert found[0] == "target" and found[7] == "dropped_unstable" and found[13] == "field" and list(found.values()).count("check") == 4


def test_few_stars_are_never_pruned_below_five(spark):
    d, _, _ = night(seed=2, stars=7, frames=20, holes=0)
    for s in (3, 4, 5, 6):
        d.loc[d.star == s, "mag"] += (0.3 * s) * np.sin(np.linspace(0, 9 + s, 20))
    found = {r["star"]: r["role"] for r in E.comparison_stars(spark.createDataFrame(d), "k", "star", "frame", "mag", "sigma").collect()}
    assert list(found.values()).count("comp") == 5 and found == brute_roles(d, -1)


def test_flux_ratio_follows_the_sky_and_not_a_lost_star(spark):
    rng = np.random.default_rng(4)
    sky, base = np.where(np.arange(80) % 17 == 3, 0.5, 1.0), rng.uniform(500, 5000, 25)
    rows = [("n", s, f, float(base[s] * sky[f])) for s in range(25) for f in range(80) if not (s == 3 and f == 10)] + [("n", 99, 1, 1e9), ("n", 4, 80, float("nan"))]
    found = {r["frame"]: (r["ratio"], r["n"]) for r in E.flux_ratio(spark.createDataFrame(rows, "k string, star int, frame int, rate double"), ["k"], "star", "frame", "rate").collect()}
    assert all(found[f][0] == pytest.approx(sky[f]) for f in range(80)) and found[10][1] == 24 and found[1][1] == 25 and found[80] == (None, 0)


def test_greedy_pairs_equal_the_ordered_walk(spark):
    rng = np.random.default_rng(6)
    rows = sorted({(g, int(a), int(b)): (g, int(a), int(b), float(d)) for g, a, b, d in zip(rng.choice(["x", "y"], 400), rng.integers(0, 40, 400), rng.integers(0, 40, 400), np.round(rng.uniform(0, 1, 400), 1))}.values(), key=lambda r: (r[3], r[1], r[2]))
    wanted, used = set(), set()
    for g, a, b, d in rows:
        if not {(g, "a", a), (g, "b", b)} & used:
            wanted.add((g, a, b, d))
            used |= {(g, "a", a), (g, "b", b)}
    df = spark.createDataFrame(rows, "g string, a int, b int, d double")
    assert {tuple(r) for r in J.greedy_pairs(df, "g", "a", "b", "d").collect()} == wanted
    assert J.greedy_pairs(df.limit(0), "g", "a", "b", "d").count() == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, id string, night int, t double, y double, w double, star int, frame int, mag double, sigma double")
    sums = P.night_sums(df, ["id"], "night", "t", "y", "w", 1.0, 2.0, 5)
    assert P.power_of(sums, ["id"], 1.0, 2.0, 5).count() == 0 and P.bootstrapped_period(sums, ["id"], "night", 1.0, 2.0, 5, 3).count() == 0
    assert P.bootstrapped_threshold(df, ["k"], "night", "y", 3).count() == 0 and P.bootstrapped_ratio(df, ["k"], "star", "y", "w", 3).count() == 0
    assert E.ensembles(df, "k", "star", "frame", "mag", "sigma").count() == 0 and E.comparison_stars(df, "k", "star", "frame", "mag", "sigma").count() == 0
    assert E.flux_ratio(df, ["k"], "star", "frame", "mag").count() == 0
