"""Lines of spectra that were put there, against loops over the pixels."""

import numpy as np
import pandas as pd
import pytest

from seriesforge.operators import spectra as S


def spectrum(seed, disp=1.1, bands=True, line=60.0):
    rng = np.random.default_rng(seed)
    x = np.arange(1600)
    f = 500 + 0.05 * x + rng.normal(0, 1, len(x)) + line * np.exp(-0.5 * ((x - 400.3) / 4) ** 2)
    for sep, depth in ((6867.2 - 6562.8, 40), (7593.7 - 6562.8, 60)):
        if bands:
            f -= depth * np.exp(-0.5 * ((x - 400.3 - sep / disp) / 3) ** 2)
    return f


def brute(f, window=151):
    """Residual and noise by a loop."""
    filled = np.where(np.isfinite(f), f, np.nanmedian(f))
    r = np.array([f[i] - np.median(filled[max(0, i - window // 2) : i + window // 2 + 1]) for i in range(len(f))])
    ok = r[np.isfinite(r)]
    return np.where(np.isfinite(r), r, 0), max(1.4826 * np.median(np.abs(ok - np.median(ok))), 1e-9)


def test_anchors_are_found(spark):
    spectra = {"both": spectrum(1), "line": spectrum(2, bands=False), "none": spectrum(3, bands=False, line=0), "holes": spectrum(4)}
    spectra["holes"][[10, 700, 1500]] = np.nan
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "x": np.arange(len(f)), "f": f}) for k, f in spectra.items()]))
    rows = S.residuals(df, ["k"], "x", "f").cache()
    found = {r["k"]: r for r in S.anchors(df, ["k"], "x", "f").collect()}
    assert {k: r["status"] for k, r in found.items()} == {"both": "line+bands", "line": "line_only", "none": "none", "holes": "line+bands"}
    for k in ("both", "holes"):
        assert found[k]["x_line"] == pytest.approx(400.3, abs=0.3) and found[k]["a_per_px"] == pytest.approx(1.1, rel=0.01) and found[k]["x_a"] > found[k]["x_b"] > 400
    for k, f in spectra.items():
        r, noise = brute(f)
        mine = rows.where(f"k = '{k}'").orderBy("x").toPandas()
        assert np.allclose(mine.residual, r) and mine.noise[0] == pytest.approx(noise)
    peak = S.emission_peaks(rows, ["k"]).where("k = 'both'").first()
    r, noise = brute(spectra["both"])
    i = int(np.argmax(r))
    lo = hi = i
    while r[lo - 1] > r[i] / 2:
        lo -= 1
    while r[hi + 1] > r[i] / 2:
        hi += 1
    assert (peak["x"], peak["snr"], peak["width_px"]) == pytest.approx((np.sum(r[lo : hi + 1] * np.arange(lo, hi + 1)) / r[lo : hi + 1].sum(), r[i] / noise, hi - lo + 1))
    dips = S.dips(rows.where("k = 'both'"), ["k"]).collect()
    assert {abs(d["x"] - 400.3 - s / 1.1) < 2 for d, s in zip(sorted(dips, key=lambda d: d["x"]), (304.4, 1030.9))} == {True} and len(dips) == 2


def test_hits_and_slopes_are_no_peaks(spark):
    f = np.full(800, 100.0) + np.random.default_rng(5).normal(0, 1, 800)
    hit, wide = f.copy(), f.copy()
    hit[300] += 500
    wide[200:300] += 50
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "x": np.arange(800), "f": v}) for k, v in (("hit", hit), ("wide", wide))]))
    assert S.emission_peaks(S.residuals(df, ["k"], "x", "f", 601), ["k"]).count() == 0


def test_snippets_and_empty_tables(spark):
    df = spark.createDataFrame([("a", i, 2.0 + (i == 50)) for i in range(100)], "k string, x int, f double")
    found = {r["offset"]: r["flux"] for r in S.snippets(df, ["k"], "x", "f", spark.createDataFrame([("a", 50.2)], "k string, x double"), 6, 3).collect()}
    assert found == {-6: 1.0, -3: 1.0, 0: 1.5, 3: 1.0, 6: 1.0}
    assert S.anchors(df.limit(0), ["k"], "x", "f").count() == 0
