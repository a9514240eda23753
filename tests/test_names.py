"""Rules of names on names as they come, and chains of aliases."""

import pytest
from pyspark.sql import functions as F

from seriesforge.functions import names as N
from seriesforge.operators import aliases as A

NAMES = {
    None: (None, "blank"), "": (None, "blank"), "  \t": (None, "blank"), "T CrB": ("tcrb", "casefold,separators"), "t crb": ("tcrb", "separators"), "* tet CrB": ("tetcrb", "prefix_junk,casefold,separators"),
    "V* KV UMa": ("kvuma", "prefix_junk,casefold,separators"), "mjcMay01 yzcnc": ("yzcnc", "observer_prefix"), "ST-LMi-y-series": ("stlmi", "series_suffix,casefold,separators"), "STLMi-z-series": ("stlmi", "series_suffix,casefold"),
    "PHECDA lrg 0-25s": ("phecda", "exposure_tokens,casefold"), "Vega 0p001s lrg 5": ("vega", "exposure_tokens,casefold"), "tet CrB hrg 2-4s": ("tetcrb", "exposure_tokens,casefold,separators"), "  RR   Lyrae ": ("rrlyr", "whitespace,genitive,casefold,separators"),
    "ZTFJ082835 05-052702 1": ("ztfj08283505-0527021", "casefold,separators"), "ksi UMa B": ("ksiumab", "casefold,separators"), "AG LMi": ("aglmi", "casefold,separators"), "60s": ("60s", ""), "alpha Lyr": ("vega", "casefold,separators,synonym"),
    "Pinwheel Galaxy": ("m101", "casefold,separators,synonym"), "Vega g 2": ("vegag2", "casefold,separators"), "ST-LMi": ("stlmi", "casefold,separators"),
}


def test_rules(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "raw string").select("raw", N.normalised_target("raw").alias("n"))
    assert {r["raw"]: (r["n"]["key"], ",".join(r["n"]["rules"])) for r in df.collect()} == NAMES
    one = df.where("raw = 'alpha Lyr'").first()["n"]
    assert one["pre_synonym_key"] == "alphalyr" and one["cleaned"] == "alpha Lyr"


def test_chains_end_in_one_name_and_cycles_raise(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(37)] + [("x", "n5"), ("y", "y"), (None, "n1")], "key string, to string")
    found = {r["key"]: r["to"] for r in A.followed(chain).collect()}
    assert set(found.values()) == {"n37"} and len(found) == 38
    for pairs in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("z", "a")]):
        with pytest.raises(ValueError, match="cycle"):
            A.followed(spark.createDataFrame(pairs, "key string, to string"))
    assert A.followed(chain.limit(0)).count() == 0


def test_aliases_far_apart_are_refused(spark):
    places = A.medians(spark.createDataFrame([("a", 359.9, 10.0), ("a", 0.1, 10.0), ("a", 0.0, 10.1), ("b", 0.05, 10.0), ("c", 90.0, 0.0), (None, 1.0, 1.0), ("d", None, 1.0)], "key string, ra double, dec double"), "key")
    at = {r["key"]: (r["ra"], r["dec"]) for r in places.collect()}
    assert set(at) == {"a", "b", "c"} and at["a"] == pytest.approx((0.0, 10.0), abs=1e-9)
    pairs = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "a")], "key string, to string")
    assert {r["key"]: r["accepted"] for r in A.confirmed(pairs, places).collect()} == {"b": True, "c": False, "d": True}


def test_groups_show_their_most_frequent_name(spark):
    names = spark.createDataFrame([("Vega", "vega", 5), ("VEGA", "vega", 5), ("alpha Lyr", "alphalyr", 9), (None, None, 2), ("T CrB", "tcrb", 1)], "raw string, key string, n long")
    out = {r["raw"]: (r["key"], r["display"]) for r in A.alias_groups(names, spark.createDataFrame([("alphalyr", "vega")], "key string, to string")).collect()}
    assert out == {"Vega": ("vega", "alpha Lyr"), "VEGA": ("vega", "alpha Lyr"), "alpha Lyr": ("vega", "alpha Lyr"), None: (None, None), "T CrB": ("tcrb", "T CrB")}
    assert A.alias_groups(names.withColumn("n", F.lit(1)), spark.createDataFrame([], "key string, to string")).where("raw = 'Vega'").first()["display"] == "VEGA"
