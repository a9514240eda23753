"""Noise operators on rows with NULL, NaN, ties and few values, and against plain numpy."""

import datetime as dt
import math

import numpy as np
import pytest

from seriesforge.operators import noise as N


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_star_stats_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(s, float(15 + rng.normal(0, 0.02)), float(rng.uniform(0.005, 0.03)), float(rng.normal(0, 0.1))) for s in (1, 2, None) for _ in range(40)]
    df = spark.createDataFrame([*data, (1, None, 0.01, 0.0), (1, float("nan"), 0.01, 0.0), (3, 14.0, 0.01, 0.0), (4, 14.0, None, 0.0)], "star int, mag double, sigma double, zero double")
    found = rows(N.star_stats(df, ["star"], "mag", "sigma", "zero"), "star")
    assert set(found) == {(1,), (2,), (None,), (3,)}
    for s in (1, 2, None):
        c = np.array([m - z for k, m, _, z in data if k == s])
        v = np.array([e**2 + 0.005**2 for k, _, e, _ in data if k == s])
        mean = (c / v).sum() / (1 / v).sum()
        r = found[(s,)]
        assert r["n"] == 40
        assert [r["mean"], r["rms"], r["chi2nu"]] == pytest.approx([mean, math.sqrt(((c - mean) ** 2).mean()), ((c - mean) ** 2 / v).sum() / 39], rel=1e-9)
    assert found[(3,)]["chi2nu"] is None and found[(3,)]["rms"] == 0.0


def test_noise_floor_recovers_a_known_one(spark):
    df = spark.createDataFrame([(p, math.sqrt(1.5 * p * p + 0.008**2)) for p in (0.001, 0.004, 0.02, 0.09)] + [(None, 0.1), (0.1, 0.0)], "p double, rms double")
    got = df.agg(*[c.alias(k) for k, c in N.noise_floor("rms", "p").items()]).first()
    assert got["n"] == 4 and got["floor"] == pytest.approx(0.008, rel=1e-6) and got["k"] == pytest.approx(1.5, rel=1e-6)
    two = df.limit(2).agg(*[c.alias(k) for k, c in N.noise_floor("rms", "p").items()]).first()
    assert two["floor"] is None and two["k"] is None


@pytest.mark.parametrize(
    "medians, counts, wanted",
    [
        ([1.0, 1.1, 1.5, 1.0, 1.5, 1.6], [20] * 6, 4.0),  # a lone excursion does not count, a run does
        ([1.0, 1.1, 1.5, 1.0, 1.1, 1.6], [20] * 6, 5.0),  # the last bin may stand alone
        ([1.0, 1.1, 1.5, 1.6, 1.0, 1.1], [20, 20, 20, 3, 20, 20], None),  # a thin bin breaks a run
        ([2.0, 2.1, 1.0, 1.0, 1.1, 1.2], [20] * 6, None),  # bins before the best one do not count
        ([1.0, 2.0], [1, 1], None),
    ],
)
def test_degradation(spark, medians, counts, wanted):
    df = spark.createDataFrame([(None, float(i), m, n) for i, (m, n) in enumerate(zip(medians, counts))], "k string, centre double, median double, n long")
    (r,) = N.degradation(df, ["k"]).collect()
    assert r["threshold"] == wanted and (r["baseline"] is None) == (max(counts) < 15)


def test_degradation_with_a_given_baseline(spark):
    df = spark.createDataFrame([("a", 0.0, 2.0, 20), ("a", 1.0, 2.0, 20), ("a", 2.0, 1.0, 20)], "k string, centre double, median double, n long")
    assert N.degradation(df, ["k"], baseline=1.0).first()["threshold"] == 0.0


def test_photon_transfer_recovers_gain_and_noise(spark):
    df = spark.createDataFrame([(x, 9.0 + x / 2.5, 400) for x in (10.0, 100.0, 1000.0, 5000.0)] + [(None, 1.0, 5)], "level double, var double, n int")
    got = df.agg(*[c.alias(k) for k, c in N.photon_transfer("level", "var", "n").items()]).first()
    assert [got["gain"], got["read_noise"], got["read_noise_e"], got["n"]] == pytest.approx([2.5, 3.0, 7.5, 4], rel=1e-9)
    flat = spark.createDataFrame([(x, 9.0, 400) for x in (10.0, 100.0, 1000.0)], "level double, var double, n int")
    assert flat.agg(N.photon_transfer("level", "var", "n")["gain"].alias("g")).first()["g"] is None


def test_red_noise_reaches_only_measured_rungs(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (4.0, 1.0), (8.0, None)], "tau double, dev double")
    red = N.red_noise("tau", "dev", 100.0)
    got = df.agg(red["factor"].alias("f"), red["tau_used"].alias("t"), N.allan_slope("tau", "dev").alias("s")).first()
    assert got["f"] == pytest.approx(2.0) and got["t"] == 4.0 and got["s"] == pytest.approx(0.0, abs=1e-12)
    assert df.limit(1).agg(red["factor"].alias("f")).first()["f"] is None


def test_plateau_stops_at_the_first_faded_night(spark):
    night = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    mags = [12.0, 16.0, 12.5, 11.0, 11.0, 12.4, 15.0, 11.5]
    df = spark.createDataFrame([("e", night(i), m) for i, m in enumerate(mags)] + [("e", None, 1.0), ("f", night(0), None)], "e string, night date, mag double")
    (r,) = N.plateau_span(df, ["e"], "night", "mag").collect()
    assert (r["peak_night"], r["start"], r["stop"], r["days"]) == (night(3), night(2), night(5), 4)


def test_baseline_and_band_offset_need_enough_nights(spark):
    df = spark.createDataFrame([("a", float(m)) for m in range(20)] + [("b", 1.0)] * 4 + [("a", None)], "k string, mag double")
    got = rows(N.quiescent_baseline(df, ["k"], "mag"), "k")
    assert got[("a",)]["baseline"] == 18.5 and got[("b",)]["baseline"] is None
    obs = spark.createDataFrame([("s", 1, "R", 14.0), ("s", 1, "V", 13.0), ("s", 2, "R", 15.0), ("s", 2, "C", 14.5), ("s", 3, "R", 9.0), ("s", 4, None, 9.0)], "k string, night int, band string, mag double")
    (r,) = N.band_offset(obs, ["k"], "night", "band", "mag", "R", ["V", "C"]).collect()
    assert r["n"] == 2 and r["median"] == 0.75


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, x double, y double, n long, d date")
    curve = N.noise_curve(df, ["k"], "x", "y")
    for out in (curve, N.plateau(curve, ["k"]), N.degradation(curve, ["k"]), N.star_stats(df, ["k"], "x", "y", "y"), N.quiescent_baseline(df, ["k"], "x"), N.coverage(df, ["k"], "x", "d", "k"), N.plateau_span(df, ["k"], "d", "x"), N.dark_noise(N.dark_floor(df, ["k"], "x", "y", "y"), ["k"])):
        assert out.collect() == []
    assert N.remaining_seconds(df, "k", df.x > 0, "y", {}, 4)[1].first()["eta_s"] == 0.0
