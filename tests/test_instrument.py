"""Frame pairs, pile-ups, ladders, offsets and sky ranges: planted truths and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import instrument as I


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_pairs_recover_gain_and_read_noise(spark):
    rng = np.random.default_rng(1)
    level = np.exp(rng.uniform(np.log(100), np.log(3000), 60_000))
    e = level * 1.05
    a, b = (rng.poisson(e) / 1.05 + rng.normal(0, 3, e.size) for _ in range(2))
    points = I.pair_points(frame(spark, k=1, a=a, b=b), ["k"], "a", "b", 10).cache()
    assert points.count() >= 5 and points.agg(F.min("n_pix")).first()[0] >= 2000
    slope = np.polyfit(*np.array([(r["level"], r["var"]) for r in points.collect()]).T, 1)[0]
    assert 1 / slope == pytest.approx(1.05, rel=0.08)


def brute_variance(d, rounds=2):
    keep = np.isfinite(d)
    for _ in range(rounds):
        m = np.median(d[keep])
        s = 1.4826 * np.median(np.abs(d[keep] - m))
        if s == 0:
            break
        keep &= np.abs(d - m) <= 4 * s
    return np.var(d[keep], ddof=1) / 2, keep.sum()


def test_clipped_variance_equals_numpy_and_ignores_hits(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0, 2, 20_000)
    d[:20] = 5000
    flat = np.r_[np.zeros(30), 1.0, 2.0]
    df = frame(spark, k=["a"] * 20_000 + ["b"] * 32 + ["c"], d=np.r_[d, flat, 1.0])
    found = {r["k"]: (r["var"], r["n"]) for r in I.clipped_pair_variance(df, ["k"], "d").collect()}
    assert found["a"] == pytest.approx(brute_variance(d)) and found["a"][0] == pytest.approx(2, rel=0.05) and found["a"][1] < 20_000
    assert found["b"] == pytest.approx(brute_variance(flat)) and found["c"] == (None, 1)


def test_pairs_without_a_span_are_one_bin(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 3, (2, 500))
    found = I.pair_points(frame(spark, k=1, a=a, b=b), ["k"], "a", "b", 10, 100).collect()
    assert [(r["bin"], r["n_pix"]) for r in found] == [(0, brute_variance(a - b)[1])]
    assert I.pair_points(frame(spark, k=1, a=a, b=b), ["k"], "a", "b", 10, 501).count() == 0


def histogram(name, top=3526, floor=50):
    h = np.zeros(4300, np.int64)
    level = np.arange(top)
    h[:top] = (1e6 * np.exp(-level / 300)).astype(np.int64) + floor
    if name == "spike":
        h[:top] = (1e6 * np.exp(-level / 300)).astype(np.int64) + 2000
        h[3526] = 200_000
    if name == "mound":
        at = np.arange(3400, 3520)
        h[at] += (700_000 * np.exp(-0.5 * ((at - 3460) / 20) ** 2)).astype(np.int64)
    if name == "hot":
        h[4200] = 5
    if name == "low":
        h[:] = 0
        h[10] = 10_000_000
    if name == "slope":
        at = np.arange(4300)
        h[:] = (2_000_000 * np.exp(-0.5 * ((at - 3000) / 60) ** 2)).astype(np.int64)
        h[3300:4200] += 900
    return h


def brute_clip(h):
    dense = np.flatnonzero(h >= 1000)
    if not len(dense) or dense[-1] < 500:
        return None
    top = dense[-1]
    lo = max(0, top - 159)
    p = lo + int(np.argmax(h[lo : top + 1]))
    valley = h[max(0, p - 300) : p + 1].min()
    ratio = h[p] / max(valley, 1)
    return None if ratio < 10 or h[top + 1 :].sum() > h[p] else (p, h[p], float(valley), ratio)


def test_pile_ups(spark):
    names = ["spike", "smooth", "hot", "low", "mound", "slope"]
    rows = [(n, int(a), int(c)) for n in names for a, c in enumerate(histogram(n)) if c]
    # Two halves of each count are merged by the operator.
    df = spark.createDataFrame(rows, "k string, level int, n long")
    halves = df.withColumn("n", F.floor(F.col("n") / 2)).unionByName(df.withColumn("n", F.col("n") - F.floor(F.col("n") / 2)))
    found = {r["k"]: tuple(r)[1:] for r in I.find_clip(halves, ["k"], "level", "n").collect()}
    assert found == {n: pytest.approx(brute_clip(histogram(n))) for n in names if brute_clip(histogram(n))}
    assert found["spike"][0] == 3526 and abs(found["mound"][0] - 3460) <= 2 and not {"smooth", "hot", "low"} & set(found)


def test_ladders(spark):
    rows = [("n1", 1.0, 3, 100.0), ("n1", 2.0, 2, 201.0), ("n1", 4.0, 5, 380.0), ("n1", 8.0, 1, 790.0), ("n2", 1.0, 9, 5.0), ("n2", 2.0, 9, 9.0), ("n3", -1.0, 9, 9.0), ("n3", None, 9, 9.0), ("n3", 1.0, 9, float("nan"))]
    df = spark.createDataFrame(rows, "night string, t double, n int, f double")
    assert [tuple(r) for r in I.ladders(df, ["night"], "t", "n").collect()] == [("n1", [1.0, 2.0, 4.0], 3, 10)]
    found = {r["exposure"]: r for r in I.fit_ladders(df, ["night"], "t", "f").collect()}
    rate = np.median([100, 100.5, 95, 98.75])
    assert set(found) == {1.0, 2.0, 4.0, 8.0} and found[4.0]["residual_pct"] == pytest.approx(100 * (95 / rate - 1)) and found[1.0]["max_residual_pct"] == pytest.approx(100 * (1 - 95 / rate)) and found[8.0]["n_rungs"] == 4


def test_every_mode_comes_before_any_repeats(spark):
    rows = [("rich", q) for q in range(50)] + [("poor", 7)]
    found = I.fair_order(spark.createDataFrame(rows, "mode string, q int"), "mode", [F.col("q")], 3).orderBy("slot", "mode").collect()
    assert [tuple(r) for r in found] == [("poor", 7, 0), ("rich", 0, 0), ("rich", 1, 1), ("rich", 2, 2)]


def test_votes_find_a_dither(spark):
    rng = np.random.default_rng(2)
    ref = rng.uniform(0, 2000, (300, 2))
    seen = ref[rng.choice(300, 60, replace=False)] - [113.3, -58.7] + rng.normal(0, 0.3, (60, 2))
    left = pd.concat([pd.DataFrame({"k": "f", "x": seen[:, 0], "y": seen[:, 1]}), pd.DataFrame({"k": "noise", "x": rng.uniform(0, 2000, 60), "y": rng.uniform(0, 2000, 60)}), pd.DataFrame({"k": "two", "x": [1.0, 2.0], "y": [1.0, 2.0]})])
    right = pd.concat([pd.DataFrame({"k": k, "x": ref[:, 0], "y": ref[:, 1]}) for k in ("f", "noise", "two")])
    found = {r["k"]: r for r in I.vote_offsets(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "x", "y", 200.0).collect()}
    assert set(found) == {"f"} and found["f"]["dx"] == pytest.approx(113.3, abs=0.2) and found["f"]["dy"] == pytest.approx(-58.7, abs=0.2)


def test_cells_and_ranges(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 1 << 10, (2, 200))
    df = frame(spark, x=x, y=y).withColumn("c", I.interleaved("x", "y", 10))
    wanted = [sum(((int(a) >> i & 1) << 2 * i) | ((int(b) >> i & 1) << 2 * i + 1) for i in range(10)) for a, b in zip(x, y)]
    assert sorted(r["c"] for r in df.collect()) == sorted(wanted)
    ids = sorted(int(v) for v in rng.integers(0, 4000, 300))
    cells = sorted({i >> 3 for i in ids})
    runs, start = [], cells[0]
    for a, b in zip(cells, [*cells[1:], None]):
        if b != a + 1:
            runs.append((start << 3, ((a + 1) << 3) - 1))
            start = b
    ranges = I.cell_ranges(spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long"), "id", 3)
    assert sorted(map(tuple, ranges.collect())) == runs


def test_ranges_reach_the_scan(spark, tmp_path):
    spark.range(10_000).write.parquet(f"{tmp_path}/t")
    ranges = spark.createDataFrame([(10, 20), (5000, 5009)], "first long, last long")
    found = spark.read.parquet(f"{tmp_path}/t").where(I.in_ranges("id", ranges))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 21 and "PushedFilters: [Or(And(GreaterThanOrEqual(id,10)" in plan
    assert spark.range(5).where(I.in_ranges("id", ranges.limit(0))).count() == 0
    with pytest.raises(ValueError, match="more than 1"):
        I.in_ranges("id", ranges, 1)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, a double, b double, level int, n long, id long")
    assert I.pair_points(df, ["k"], "a", "b").count() == 0 and I.find_clip(df, ["k"], "level", "n").count() == 0 and I.cell_ranges(df, "id").count() == 0
    assert I.ladders(df, ["k"], "a", "n").count() == 0 and I.fit_ladders(df, ["k"], "a", "b").count() == 0 and I.vote_offsets(df, df, ["k"], "a", "b", 5.0).count() == 0
