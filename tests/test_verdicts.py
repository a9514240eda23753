"""NaN, infinity and NULL in every place of the ladders, and rungs at their bounds."""

import math

import pytest
from pyspark.sql import functions as F

from seriesforge.functions import verdicts as V
from seriesforge.sources import text as X

NAN, INF = float("nan"), float("inf")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(v):
    return F.lit(None).cast("double") if v is None else F.lit(v)


MISSING = [NAN, None]


@pytest.mark.parametrize("bad", [NAN, INF, -INF, None])
def test_unmeasured_values_are_unknown(spark, bad):
    b = lit(bad)
    assert one(spark, V.night_state(b, F.lit(15.0))) == "UNKNOWN" and one(spark, V.night_state(F.lit(15.0), b)) == "UNKNOWN"
    assert one(spark, V.capability(b, F.lit(1.0))) == "UNTESTED" and one(spark, V.capability(F.lit(1.0), b, False)) == "UNTESTED"
    assert one(spark, V.block_verdict(F.lit(9), F.lit(5), b, F.lit(True))) == "TIED-UNVERIFIED"
    assert one(spark, V.family_choice(F.lit(1), b, F.lit(True))) == "UNRESOLVED"
    for k in range(4):
        four = [F.lit(1.0)] * 4
        four[k] = b
        assert one(spark, V.detection_call(*four, F.lit(9.0))) == "UNTESTED"
    assert one(spark, V.detection_call(*[F.lit(1.0)] * 3, F.lit(0.5), b)) == "DETECTED"
    for gate in (V.snr_gate(b, F.lit(1.0)), V.snr_gate(F.lit(1.0), b)):
        assert one(spark, gate["passes"]) is False and one(spark, gate["ratio"]) is None and one(spark, gate["margin"]) is None
    assert one(spark, V.contour_reached(b)) == "UNTESTED"
    assert one(spark, V.colour_position(b, F.lit(0.1), F.lit(1.0), F.lit(0.2), F.lit(0.9))) == "unknown"
    assert one(spark, V.range_check(b, F.lit(1.0), F.lit(2.0), 0.1)) == "unknown" and one(spark, V.range_check(F.lit(1.0), F.lit(1.0), b, 0.1)) == "unknown"
    assert one(spark, V.transmission_label(b, 0.05, 0.3)) == ""
    assert one(spark, V.agreement_test(b, F.lit(1.0), F.lit(1.0), F.lit(1.0))["agrees"]) is False
    assert one(spark, V.mid_method(F.lit(""), b, F.lit(1.0))) == "no_jd" and one(spark, V.compact_seconds(b)) == "?s"
    assert one(spark, V.geometry_verdict(F.lit(100), F.lit(100), b)) == "no aperture"


@pytest.mark.parametrize("bad", MISSING)
def test_nan_is_not_above_a_bound(spark, bad):
    b = lit(bad)
    for k in range(3):
        three = [F.lit(9.0), F.lit(1.0), F.lit(5.0)]
        three[k] = b
        assert one(spark, V.is_saturated(*three)) is False
    assert one(spark, V.position_quality(b, F.lit(True))) == "wcs_off"
    assert one(spark, V.saturation_class(b, F.lit("wcs"), F.lit(1), F.lit(2))) == "undetermined"
    assert one(spark, V.diagnose(F.lit(50), F.lit(40), b, b, b)) == "unexplained"
    assert one(spark, V.solution_sane(F.lit(1.0), F.lit(20), b, F.lit(0.5), F.lit(2.0), 8, 2.0)) is False
    assert one(spark, V.bright_limit_risk(b, F.lit(3.0))) is False and one(spark, V.bright_limit_risk(F.lit(3.0), b)) is False
    assert one(spark, V.qc_flags(F.lit(""), b, b, F.lit(1.0), F.lit(1.0), F.lit("t"), b)) == ""
    assert one(spark, V.effective_exposure(b, F.lit("x_20s_.fits"))) == 20
    assert one(spark, V.strength(b, F.lit(10.0))) == "n/a"


def test_infinite_peaks_are_saturated(spark):
    assert one(spark, V.is_saturated(F.lit(INF), F.lit(0.0), F.lit(5.0))) is True


def test_bounds_of_the_rungs(spark):
    state = lambda rise: one(spark, V.night_state(F.lit(15.0 - rise), F.lit(15.0)))
    assert [state(x) for x in (1.0, 0.75, 0.5, -2.0)] == ["OUTBURST", "ELEVATED", "QUIESCENT", "QUIESCENT"]
    assert one(spark, V.capability(F.lit(1.0), F.lit(1.0))) == "SUPPORTED" and one(spark, V.capability(F.lit(1.0), F.lit(1.0), False)) == "SUPPORTED"
    tie = lambda n, c, rms, ok=True: one(spark, V.block_verdict(F.lit(n), F.lit(c), F.lit(rms), F.lit(ok)))
    assert [tie(7, 9, 0.001), tie(8, 9, 0.01), tie(8, 4, 0.02), tie(8, 4, 0.021), tie(8, 3, 0.001), tie(8, 9, 0.001, False)] == ["UNTIED", "TIED-STRETCH", "TIED-GOAL", "TIED-ABOVE-GOAL", "TIED-UNVERIFIED", "UNTIED"]
    call = lambda a, p, cycles=9.0: one(spark, V.detection_call(F.lit(a), F.lit(1.0), F.lit(p), F.lit(1.0), F.lit(cycles)))
    assert [call(1.0, 1.1), call(1.0, 1.0), call(0.9, 1.1), call(0.9, 1.0), call(2.0, 2.0, 1.4)] == ["DETECTED", "MARGINAL", "MARGINAL", "NOT DETECTED", "AMPLITUDE ONLY"]
    assert [one(spark, V.family_choice(F.lit(n), F.lit(a), F.lit(p))) for n, a, p in ((12, 0.92, True), (1, 0.97, True), (12, 0.1, True), (12, 0.92, False))] == ["PRIOR", "SINGLE-NIGHT", "DATA", "UNRESOLVED"]


@pytest.mark.parametrize("x", [240.0, 240.12345, 0.1, 0.0001, 12.5, 100000.0, 0.0, 1234567.0, 0.00001234, 3.0000001, 59.9999999])
def test_seconds_have_six_significant_digits(spark, x):
    assert one(spark, V.compact_seconds(F.lit(x))) == f"{x:g}s"


def test_flagged_rows_stay_with_a_note(spark):
    rows = spark.createDataFrame([("1.5", "0"), ("1.6", "2"), ("x", "0"), ("1.7", None), ("nan", "1"), (None, "1")], "mag string, catflags string")
    assert [tuple(r) for r in X.measured(rows, "mag", "catflags").select("mag", "note").collect()] == [(1.5, ""), (1.6, "catflags=2"), (1.7, "")]


def test_observations(spark):
    rows = spark.createDataFrame([
        ("2450000.5", "15.1", "0.02", "V", "abc", "Taken with the SURVEY scope", "0", "CCD"), ("2450000.6", "<15", "", "V", "", "", "1", ""), ("inf", "15", "", "", "", "", "", ""),
        ("2450000.7", "16.2", "x", "", " Me ", None, "1", None), ("2450000.8", "nan", "", "V", "", "", "0", ""),
    ], "JD string, mag string, uncert string, band string, by string, comment string, fainterThan string, obsType string")
    found = [tuple(r) for r in X.observations(rows, ["ME"], ["survey"]).collect()]
    assert found == [(2450000.5, 15.1, 0.02, "V", "abc", True, False, "CCD"), (2450000.7, 16.2, None, "?", "Me", True, True, "")]
    assert X.observations(rows.select("JD", "mag"), [], []).where("is_own OR is_limit").count() == 0
    with pytest.raises(ValueError, match="mag"):
        X.observations(rows.select("JD"), [], [])
    assert math.isfinite(found[0][0]) and X.observations(rows.limit(0), ["A"], ["b"]).count() == 0
