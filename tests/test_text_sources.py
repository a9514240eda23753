import pytest
from pyspark.sql import functions as F

from seriesforge.sources import text as X


def test_delimited_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("JD@@@ mag @@@band@@@flag\n2460000.5@@@12.25@@@V@@@0\n2460001.5@@@<15.2@@@V@@@0\n2460002.5@@@13@@@@@@1\n2460003.5@@@ 14.5 @@@ B@@@\n")
    rows = X.read_delimited(spark, str(tmp_path / "a.txt"), "@@@", ["JD", "mag"])
    assert [(r.JD, r.mag, r.band, r.note) for r in X.measured(rows, "mag", "flag").orderBy("JD").collect()] == [("2460000.5", 12.25, "V", ""), ("2460002.5", 13.0, None, "flag=1"), ("2460003.5", 14.5, "B", "")]
    with pytest.raises(ValueError, match="uncert"):
        X.read_delimited(spark, str(tmp_path / "a.txt"), "@@@", ["JD", "uncert"])


def test_cards(spark):
    pad = lambda *x: "".join(c.ljust(80) for c in x)
    blocks = [pad("NAXIS1  =  10", "NAXIS2  = 20 / rows", "OBJECT  = 'a/b ''c'' ' / x", "END", "NAXIS1  = 99"), pad("ZIMAGE  = T", "NAXIS1  = 8", "NAXIS2  = 3", "ZNAXIS1 = 4096", "ZNAXIS2 = 2048"), pad("NAXIS1  = 0", "NAXIS2  = 5"), "", None, pad("HISTORY = no") [:40]]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, block string").withColumn("found", X.cards("block"))
    x, y = X.geometry("found")
    got = {r.i: (r.x, r.y, r.o) for r in df.select("i", x.alias("x"), y.alias("y"), X.card("found", "OBJECT").alias("o")).collect()}
    assert got[0] == (10, 20, "a/b 'c'") and got[1] == (4096, 2048, None) and got[2] == got[3] == got[4] == (None, None, None)


def test_header_blocks_are_cut_once(spark):
    """Each step of cards() names its input once, so that the block is not worked out again for each card."""
    plan = spark.range(1).select(X.cards(F.upper(F.concat(F.lit("a"), F.col("id").cast("string")))).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("upper(") == 1
