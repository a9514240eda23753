"""Edge rules that the driver's tables do not show: NaN and NULL, ties, hot keys, known truths."""

import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import scalars as S
from seriesforge.operators import ensemble as E
from seriesforge.operators import fitting as L
from seriesforge.operators import joins as J
from seriesforge.operators import robust as R
from seriesforge.operators import series as T
from seriesforge.operators import workflow as W
from seriesforge.operators.dedup import canonical_rows
from seriesforge.streaming import sessions as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    lit = F.lit
    assert one(spark, S.reduced_stem(lit("/a/b/img_1_cal_wcs_12.fits.fz"))) == "img_1"
    assert one(spark, S.reduced_stem(lit("img_12.fit"))) == "img_12"
    assert one(spark, S.normalise_name(lit(" ss_cyg-30s 1x60 "))) == "SS CYG"
    assert one(spark, S.series_key(lit("T"), lit(3), lit(" "))) == "T|e3|none"
    assert one(spark, S.parse_series_key(lit("T|e3|none"))) == ("T", 3, None)
    assert one(spark, S.dup_key(lit("/x/a.fits"), lit(float("nan")), lit(7))) == "#7"
    assert one(spark, S.config_key([lit(None), lit(1)])) == "∅|1"
    assert one(spark, S.is_master(lit("/c/Master_dark.fits")))


def test_times(spark):
    assert one(spark, S.night_label(F.lit(2460000.5))).isoformat() == "2023-02-24"
    assert one(spark, S.fold_phase(F.lit(-0.25), 0.0, 1.0)) == -0.25 and one(spark, S.phase_of(F.lit(-0.25), 0.0, 1.0)) == 0.75
    assert one(spark, S.exposure_bin(F.lit(10.0000159))) == 10.0 and one(spark, S.exposure_bin(F.lit(0.0))) == 0.0
    assert one(spark, S.exposure_bin(F.lit(None))) is None
    back = one(spark, S.jd_of(S.timestamp_of(F.lit(2460123.25))))
    assert abs(back - 2460123.25) < 1e-9


def test_geometry(spark):
    assert abs(one(spark, S.separation_deg(F.lit(359.9), F.lit(0.0), F.lit(0.1), F.lit(0.0))) - 0.2) < 1e-9
    assert abs(one(spark, S.haversine_deg(F.lit(10.0), F.lit(89.0), F.lit(190.0), F.lit(89.0))) - 2.0) < 1e-9
    xi, eta = S.tangent_project(F.lit(101.0), F.lit(21.0), 100.0, 20.0)
    ra, dec = S.tangent_deproject(xi, eta, 100.0, 20.0)
    assert abs(one(spark, ra) - 101) < 1e-9 and abs(one(spark, dec) - 21) < 1e-9
    assert one(spark, S.sexagesimal(F.lit("-00:30:00"))) == -0.5 and one(spark, S.sexagesimal(F.lit("12 30 00"), True)) == 187.5
    assert one(spark, S.sexagesimal(F.lit("junk"))) is None


def test_units(spark):
    assert one(spark, S.instrumental_mag(F.lit(0.0))) is None and abs(one(spark, S.instrumental_mag(F.lit(100.0))) - 20) < 1e-12
    assert one(spark, S.quadrature_excess(F.lit(3.0), F.lit(5.0))) is None and one(spark, S.quadrature_excess(F.lit(5.0), F.lit(3.0))) == 4.0
    assert one(spark, S.within_tolerance(F.lit(30.15), F.lit(30.0), 0.02, 0.005)) and not one(spark, S.within_tolerance(F.lit(30.16), F.lit(30.0), 0.02, 0.005))
    assert one(spark, S.classify_state(F.lit(None), 1.0, 2.0)) == "UNKNOWN" and one(spark, S.classify_state(F.lit(1.0), 1.0, 2.0)) == "INTERMEDIATE"
    assert one(spark, S.passes_list(F.lit(" "), denied=["x"])) and not one(spark, S.passes_list(F.lit(" "), allowed=["x"]))
    assert one(spark, S.finite(F.lit(float("inf")))) is None


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, x double")
    got = {r.k: (r.n, r.median, r.mad_sigma) for r in R.median_and_mad(df, ["k"], "x").collect()}
    assert got == {None: (2, 2.0, 1.4826), "a": (1, 5.0, None)}
    rows = canonical_rows(df, [F.col("k")], [F.col("x")], ["x"]).collect()
    assert sorted((r.x, r.group_size) for r in rows) == [(1.0, 2), (5.0, 1)]


def test_survival_with_ties(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("a", 2, True), ("a", 3, True)], "k string, t int, e boolean")
    got = [(r.t, r.at_risk, r.events, round(r.survival, 9)) for r in R.kaplan_meier(df, ["k"], "t", F.col("e")).orderBy("t").collect()]
    assert got == [(1, 4, 1, 0.75), (2, 2, 1, 0.375), (3, 1, 1, 0.0)]


def test_wrapped_median(spark):
    df = spark.createDataFrame([("a", 359.0), ("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 30.0)], "k string, ra double")
    assert {r.k: r.median_deg for r in R.wrapped_median_deg(df, ["k"], "ra").collect()} == {"a": 1.0, "b": 20.0}


def test_asof_over_slices(spark):
    rng = np.random.default_rng(3)
    left = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 1000, 300)))] + [(0, None, 999), (9, 5, 1000)]
    right = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(0, 1000, 40)))]
    a, b = spark.createDataFrame(left, "k int, t long, id int"), spark.createDataFrame(right, "k int, t long, rid int")
    for strict in (False, True):
        for how in ("backward", "forward", "nearest"):
            got = {r.id: (r.r_t, r.r_rid) for r in J.asof(a, b, ["k"], "t", "t", ["rid"], how, strict, width=50.0).collect()}
            for k, t, i in left:
                own = [] if t is None else [(s, r) for q, s, r in right if q == k and not (strict and s == t)]
                if how == "backward":
                    own = [(t - s, s, r) for s, r in own if s <= t]
                elif how == "forward":
                    own = [(s - t, s, r) for s, r in own if s >= t]
                else:
                    own = [(abs(s - t), s, r) for s, r in own]
                assert got[i] == (min(own)[1:] if own else (None, None)), (how, strict, k, t)


def test_hot_cells_are_dealt_over_tasks(spark):
    a = spark.range(301).select(F.col("id").alias("i"), F.lit(7).alias("c")).unionByName(spark.createDataFrame([(900, 8), (901, 9)], "i long, c int"))
    b = spark.range(250).select(F.col("id").alias("j"), F.lit(7).alias("c")).unionByName(spark.createDataFrame([(900, 8), (902, None)], "j long, c int"))
    pairs = J.cell_join(a, b, ["c"], block=50, task_pairs=5000).withColumn("p", F.spark_partition_id()).toPandas()
    assert len(pairs) == 301 * 250 + 1 and not pairs.duplicated(["i", "j"]).any()
    assert set(map(tuple, pairs[pairs.c != 7][["i", "j"]].values)) == {(900, 900)}
    assert pairs.groupby("p").size().max() < len(pairs) / 3
    assert J.cell_join(a.where("false"), b, ["c"]).count() == 0


def test_quantiles_by_ranges_and_by_sorted_groups(spark):
    rng = np.random.default_rng(5)
    groups = {None: rng.integers(0, 9, 500).astype(float), 1: rng.normal(0, 1, 3001), 2: np.array([4.0, 7.0]), 3: np.array([1.5])}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [(1, float("nan")), (4, None)], "k int, x double").repartition(4)
    for small in (False, True):
        got = {r.k: r for r in R.quantiles(df, ["k"], "x", [0.0, 0.3, 0.5, 1.0], small).collect()}
        spread = {r.k: r for r in R.median_and_mad(df, ["k"], "x", small).collect()}
        assert set(got) == set(spread) == set(groups)
        for k, x in groups.items():
            assert got[k].n == len(x) and np.allclose(got[k].q, np.quantile(x, [0.0, 0.3, 0.5, 1.0]))
            mad = 1.4826 * np.median(np.abs(x - np.median(x)))
            assert spread[k].median == pytest.approx(np.median(x)) and (spread[k].mad_sigma == pytest.approx(mad, rel=1e-4) if len(x) > 1 else spread[k].mad_sigma is None)


def test_medians_come_back_to_hot_groups_without_a_sort(spark):
    spark.range(3000).select((F.col("id") % 2).alias("k"), *[F.rand(i).alias(c) for i, c in enumerate("xyz")]).write.mode("overwrite").parquet(path := tempfile.mkdtemp() + "/rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20KB")
    try:
        plan = R.median_and_mad(spark.read.parquet(path), ["k"], "x")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_join_includes_its_ends(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.5)], "i int, x double")
    b = spark.createDataFrame([(1, 1.5), (2, 0.5), (3, 0.4), (4, -9.0)], "j int, y double")
    assert sorted((r.i, r.j) for r in J.range_join(a, b, "x", "y", 0.5).collect()) == [(1, 1), (1, 2)]


def test_sessions_split_beyond_the_gap(spark):
    df = spark.createDataFrame([("a", 0.0, 1), ("a", 10.0, 2), ("a", 20.5, 3), ("a", 20.5, 4)], "k string, t double, id int")
    assert [r.block for r in T.sessions(df, ["k"], "t", 10.0, "id").orderBy("id").collect()] == [0, 0, 1, 1]


def test_period_is_found(spark):
    t = np.sort(np.random.default_rng(1).uniform(0, 40, 400))
    df = spark.createDataFrame(pd.DataFrame({"star": "a", "t": t, "y": 3 + 2 * np.sin(2 * math.pi * 1.37 * t)}))
    grid = T.periodogram(df, ["star"], "t", "y", None, 1.0, 2.0, 401)
    best = T.refine_peak(grid, ["star"], 1 / 400).first()
    assert abs(best.f - 1.37) < 1e-3 and best.power > 0.99
    fit = L.harmonic_fits(df, "star", "t", "y", 1 / 1.37, 1).first()
    assert abs(fit.amplitude - 2) < 1e-6 and fit.rms < 1e-6
    theta = {r.f: r.theta for r in T.dispersion_theta(df, ["star"], "t", "y", [1.37, 1.6]).collect()}
    assert theta[1.37] < 0.1 < theta[1.6]


def test_ensemble_recovers_known_truth(spark):
    rng = np.random.default_rng(5)
    m, z = rng.normal(15, 1, 20), rng.normal(0, 0.3, 30)
    rows = [("s", i, j, float(m[i] + z[j] + rng.normal(0, 0.005) + (3.0 if (i, j) == (2, 3) else 0)), 0.005) for i in range(20) for j in range(30) if rng.random() > 0.15]
    df = spark.createDataFrame(rows, "series string, star int, frame int, mag double, sigma double")
    got = E.ensembles(df, "series", "star", "frame", "mag", "sigma").collect()
    zp = {int(r.id): r.value for r in got if r.kind == "frame"}
    d = np.array([zp[j] - z[j] for j in range(30)])
    assert np.std(d) < 0.006


def test_huber_line(spark):
    x = np.arange(50.0)
    y = 2 * x + 1
    y[7] += 500
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y}))
    r = L.robust_lines(df, "k", "x", "y").first()
    assert abs(r.slope - 2) < 1e-3 and r.n == 50


def test_greedy_pairs(spark):
    df = spark.createDataFrame([("g", 1, 1, 0.1), ("g", 2, 1, 0.05), ("g", 1, 2, 0.3), ("g", 2, 2, 0.06)], "g string, a int, b int, dist double")
    assert sorted((r.a, r.b) for r in J.greedy_pairs(df, "g", "a", "b", "dist").collect()) == [(1, 2), (2, 1)]


def test_pinned_ids_never_move(spark):
    first = W.pinned_ids(spark.createDataFrame([("b",), ("a",)], "k string"), spark.createDataFrame([], "k string, id long"), "k", "id")
    second = W.pinned_ids(spark.createDataFrame([("b",), ("0",), ("c",)], "k string"), first, "k", "id")
    assert {r.k: r.id for r in second.collect()} == {"b": 2, "0": 3, "c": 4}


def test_queue(spark):
    q = spark.createDataFrame([(1, "pending"), (2, "done")], "id int, status string")
    more = W.enqueue(q, spark.createDataFrame([(2, "pending"), (3, "pending")], "id int, status string"), ["id"])
    assert sorted(map(tuple, more.collect())) == [(1, "pending"), (2, "done"), (3, "pending")]
    assert [r.id for r in W.next_chunk(more, ["id"], 1).collect()] == [1]


def test_fingerprint_sees_null_and_not_order(spark):
    a = spark.createDataFrame([(1, ""), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "")], "i int, s string")
    c = spark.createDataFrame([(1, None), (2, "")], "i int, s string")
    f = lambda d: W.fingerprint(d, ["i", "s"]).first().content
    assert f(a) == f(b) != f(c)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")], "src string, dst string")
    assert {r.node for r in W.closure(edges, spark.createDataFrame([("b",)], "node string")).collect()} == {"b", "c"}
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "node string")
    assert {r.node: r.level for r in W.levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "x": 0, "y": 1}
    with pytest.raises(ValueError):
        W.levels(nodes, edges.union(spark.createDataFrame([("c", "a")], "src string, dst string")), 8)


def test_stream_leaves_out_late_rows(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for i, rows in enumerate([[("u", at(0)), ("u", at(3))], [("u", at(300))], [("u", at(310))], [("u", at(1)), ("u", at(900))]]):
        # The batch at 310 is there because Spark drops late rows by the watermark of the batch before.
        spark.createDataFrame(rows, "user string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("user string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = X.session_counts(stream, "user", "ts", "10 minutes", "1 hour").writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("sess").orderBy("start").collect()][:1] == [2]


def test_null_keys_stay_in_every_keyed_operator(spark):
    rows = [(k, float(t), t, float(t * t % 7)) for k in (None, "a") for t in range(12)]
    df = spark.createDataFrame(rows, "k string, t double, id int, x double")
    count = lambda d: {r.k for r in d.select("k").distinct().collect()}
    both = {None, "a"}
    assert count(T.without_block_means(df, ["k"], "x")) == both and T.without_block_means(df, ["k"], "x").count() == 24
    assert count(T.cadence(df, ["k"], "t", "id")) == both and T.cyclic_shift(df, ["k"], "t", "id", "x", 2).count() == 24
    assert count(R.clipped_stats(df, ["k"], "x")) == both and count(R.otsu(df, ["k"], "x")) == both and count(R.wrapped_median_deg(df, ["k"], "x")) == both
    assert T.two_way_residual(df, "k", "id", "x").count() == 24
    grid = df.select("k", F.col("id").alias("k2"), F.col("x").alias("power")).withColumnsRenamed({"k2": "f"}).withColumn("n", F.col("f"))
    assert count(T.refine_peak(grid.select("k", F.col("n").alias("j"), "f", "power").withColumnsRenamed({"k": "key", "j": "k"}).withColumnRenamed("key", "star"), ["star"], 1.0).withColumnRenamed("star", "k")) == both


def test_difference_of_tables_with_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", None)], "k string, v int")
    b = spark.createDataFrame([(None, 1), ("x", 3), ("z", None)], "k string, v int")
    assert {r.k: r.change for r in J.keyed_diff(a, b, ["k"], ["v"]).collect()} == {None: "same", "x": "content", "y": "destroyed", "z": "appeared"}


def test_cone_join_at_the_pole_and_over_zero(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(r), float(d)) for i, (r, d) in enumerate(zip(rng.uniform(0, 360, 300), rng.choice([-89.5, 0.0, 89.7, 45.0], 300) + rng.uniform(-0.4, 0.3, 300)))]
    rows += [(900, 359.9, 0.0), (901, 0.1, 0.0), (902, None, 0.0)]
    a = spark.createDataFrame(rows, "i int, ra double, dec double")
    b = a.withColumnsRenamed({"i": "j", "ra": "ra2", "dec": "dec2"})
    got = {(r.i, r.j) for r in J.cone_join(a, b, "ra", "dec", "ra2", "dec2", 0.5).collect()}
    unit = lambda r, d: np.array([math.cos(math.radians(d)) * math.cos(math.radians(r)), math.cos(math.radians(d)) * math.sin(math.radians(r)), math.sin(math.radians(d))])
    known = [(i, unit(r, d)) for i, r, d in rows if r is not None]
    want = {(i, j) for i, u in known for j, v in known if np.linalg.norm(u - v) <= 2 * math.sin(math.radians(0.5) / 2)}
    assert got == want and (900, 901) in got


def test_fingerprint_has_no_look_alikes(spark):
    f = lambda *r: W.fingerprint(spark.createDataFrame([r], "a string, b string"), ["a", "b"]).first().content
    assert len({f("a\x1f\x01b", "c"), f("a", "b\x1f\x01c"), f("a1:b", "c"), f("a", "1:bc"), f(None, ""), f("", None), f("~", "~")}) == 7


def test_deep_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src int, dst int")
    nodes = spark.range(61).select(F.col("id").cast("int").alias("node"))
    assert {r.node: r.level for r in W.levels(nodes, chain).collect()} == {i: i for i in range(61)}
    with pytest.raises(ValueError, match="cycle"):
        W.levels(nodes, chain.union(spark.createDataFrame([(60, 30)], "src int, dst int")))


def test_tasks(spark):
    tasks = spark.createDataFrame([("a", "done"), ("b", "open"), ("c", "open"), ("d", "redo")], "task string, status string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x"), ("a", "b")], "task string, need string")
    assert {r.task: r.missing for r in W.unmet(tasks, needs, ["done"]).collect()} == {"c": ["b"], "d": ["x"]}
    assert [r.task for r in W.next_up(tasks, needs, ["done"], ["task"], 5).collect()] == ["b"]
    states = spark.createDataFrame([("a", "FRESH"), ("b", "STALE"), ("c", "MISSING")], "stage string, verdict string")
    depth = spark.createDataFrame([("a", 0), ("b", 2), ("c", 1)], "node string, level int")
    assert [(r.stage, r.position) for r in W.rerun_plan(states, depth).orderBy("position").collect()] == [("c", 1), ("b", 2)]
    with pytest.raises(ValueError):
        W.assert_unique(tasks.union(tasks), ["task"])


def test_table_set(spark, tmp_path):
    from seriesforge.sources.tables import TableSet

    old, new = TableSet(spark, str(tmp_path / "old")), TableSet(spark, str(tmp_path / "new"), protected=("raw",))
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, s string")
    old.create("t", rows)
    old.create("u", rows)
    with pytest.raises(ValueError):
        old.create("t", rows)
    with pytest.raises(ValueError):
        new.swap("raw", rows)
    with pytest.raises(KeyError):
        new.read("t")
    new.swap("t", rows.where("i = 1"))
    assert new.carry(old, ["v"]) == ["u"] and new.names() == ["t", "u"] and new.read("t").count() == 1
    new.delete("u", "s = 'a'")
    new.update("u", "s is null", {"s": "'none'", "i": "i + 10"})
    new.add_column("u", "n", "long", "i * 2")
    new.rename("u", "w")
    assert sorted(map(tuple, new.read("w").collect())) == [(3, "c", 6), (12, "none", 24)] and new.names() == ["t", "w"]
    assert len(list((tmp_path / "new" / "w").glob("version-*"))) == 1
    (tmp_path / "new" / "t" / "version-half").mkdir()  # a rebuild that died
    assert new.read("t").count() == 1
