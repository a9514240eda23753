"""Trials of shifted noise: rings of the rows, thresholds, aliases."""

import numpy as np
import pandas as pd
import pytest

from seriesforge.operators import nulls as X
from seriesforge.operators import robust as R


def noise(spark, stars=3, n=60, seed=1):
    rng = np.random.default_rng(seed)
    parts = [pd.DataFrame({"field": "a", "star": s, "t": np.sort(rng.uniform(0, 9, n)), "id": np.arange(n), "y": rng.normal(0, 1, n)}) for s in range(stars)]
    parts.append(pd.DataFrame({"field": "a", "star": 99, "t": [1.0, 2.0, 3.0], "id": [0, 1, 2], "y": [1.0, 2.0, 3.0]}))
    return pd.concat(parts)


def test_places_in_ranges(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"k": np.where(rng.random(3000) < 0.7, "hot", "b"), "t": np.round(rng.uniform(0, 5, 3000), 1), "id": np.arange(3000)})
    df = spark.createDataFrame(d).unionByName(spark.createDataFrame([(None, 1.0, 1), (None, 0.5, 2)], "k string, t double, id long")).repartition(6)
    found = {(r["k"], r["id"]): (r["_i"], r["_n"]) for r in R.numbered(df, ["k"], ["t", "id"]).collect()}
    for k, g in d.groupby("k"):
        for i, x in enumerate(g.sort_values(["t", "id"])["id"]):
            assert found[k, x] == (i, len(g))
    assert found[None, 2] == (0, 2) and found[None, 1] == (1, 2) and len(found) == 3002


def test_trials_are_rings_of_one_star_and_the_same_everywhere(spark):
    d = noise(spark)
    trials = X.shifted_trials(spark.createDataFrame(d).repartition(5), ["field"], "star", "t", "id", "y", 12).toPandas()
    again = X.shifted_trials(spark.createDataFrame(d).coalesce(1), ["field"], "star", "t", "id", "y", 12).toPandas()
    order = ["trial", "t", "y"]
    assert trials.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    assert set(trials.trial) == set(range(12)) and len(set(trials.star)) > 1 and 99 not in set(trials.star)
    for (star, _), g in trials.groupby(["star", "trial"]):
        own, y = d[d.star == star].sort_values("t"), g.sort_values("t").y.to_numpy()
        assert np.allclose(g.sort_values("t").t, own.t) and any(np.allclose(y, np.roll(own.y, k)) for k in range(len(own)))


def test_thresholds(spark):
    df = spark.createDataFrame(noise(spark))
    args = (df, ["field"], "star", "t", "id", "y")
    blind, known = (X.detection_thresholds(*args, low, high, n, 40, 0.1).first() for low, high, n in ((0.5, 3.0, 26), (1.0, 1.0, 1)))
    assert blind["trials"] == known["trials"] == 40 and 0 < known["threshold"] < blind["threshold"] < 1 and blind["low"] <= blind["threshold"] <= blind["high"]
    peaks = X.highest_peaks(X.shifted_trials(*args, 40), ["field"], 0.5, 3.0, 26).toPandas()
    assert blind["threshold"] == pytest.approx(np.quantile(peaks.power, 0.9))
    spread = X.threshold_spread(*args, 1.0, 1.0, 1, 15, 0.1).first()
    assert spread["stars"] == 3 and 0 < spread["lowest"] <= spread["highest"] and spread["spread"] > 0


def test_strong_signals_are_found_and_weak_ones_are_not(spark):
    df = spark.createDataFrame(noise(spark))
    strong = X.alias_confusion(df, ["field"], "star", "t", "id", "y", 0.8, 30.0, 0.25, 4.25, 161, 8).first()
    weak = X.alias_confusion(df, ["field"], "star", "t", "id", "y", 0.8, 1e-6, 0.25, 4.25, 161, 8).first()
    assert strong["true"] == 1 and weak["true"] < 1 and weak["true"] + weak["alias"] + weak["other"] == pytest.approx(1)


def test_injected_signals_are_recovered_if_they_stand_out(spark):
    df = spark.createDataFrame(noise(spark))
    found = {r["amplitude"]: (r["trials"], r["recovered"]) for r in X.injection_recovery(df, ["field"], "star", "t", "id", "y", 0.51, [50.0, 0.01], 10).collect()}
    assert found[50.0] == (10, 10) and found[0.01][1] < 3


def test_empty_tables(spark):
    df = spark.createDataFrame([], "field string, star int, t double, id long, y double")
    args = (df, ["field"], "star", "t", "id", "y")
    assert X.detection_thresholds(*args, 1.0, 2.0, 5, 5).count() == 0 and X.threshold_spread(*args, 1.0, 2.0, 5, 5).count() == 0 and X.alias_confusion(*args, 0.8, 1.0, 1.0, 2.0, 5, 5).count() == 0
