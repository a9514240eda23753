"""Groups of names: aliases that are confirmed on the sky, chains of them followed to their end, and the name a group shows.

Aliases are a table (key, to) with one row a key. Chains are followed by doubling: each round every key takes its target's target, so
a chain of n takes log n rounds, each a written table. NULL keys are left out; empty tables give empty ones.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.scalars import separation_deg
from seriesforge.operators.robust import quantiles
from seriesforge.sources.tables import checkpointed, join_on

#: Fixed value: how far apart on the sky both sides of an alias may be, in degrees.
CONE_DEG = 0.2


def followed(aliases: DataFrame, most_rounds: int = 64) -> DataFrame:
    """key, to: the end of each key's chain. Raises on a cycle."""
    now = checkpointed(aliases.select("key", "to").where("key IS NOT NULL AND to IS NOT NULL AND key <> to"))
    for _ in range(most_rounds):
        further = now.select(F.col("key").alias("to"), F.col("to").alias("_next"))
        joined = checkpointed(now.join(further, "to", "left").select("key", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")))
        if not joined.where("key = to").isEmpty():
            break
        now = joined.select("key", "to")
        if joined.where("_moved").isEmpty():
            return now
    raise ValueError("the aliases have a cycle")


def medians(positions: DataFrame, key: str) -> DataFrame:
    """key, ra, dec of each key's positions (ra, dec in degrees): medians, the first from the direction in which the key's positions lie, so that a
    group on both sides of 0 is not split."""
    rows = positions.select(F.col(key).alias("key"), "ra", "dec").where("key IS NOT NULL AND ra IS NOT NULL AND dec IS NOT NULL")
    about = rows.groupBy("key").agg(F.degrees(F.atan2(F.avg(F.sin(F.radians("ra"))), F.avg(F.cos(F.radians("ra"))))).alias("_mid"))
    near = join_on(rows, about, ["key"]).withColumn("_d", F.pmod(F.col("ra") - F.col("_mid") + 180, F.lit(360.0)) - 180)
    ra = quantiles(near, ["key", "_mid"], "_d", [0.5]).select("key", F.pmod(F.col("_mid") + F.col("q")[0], F.lit(360.0)).alias("ra"))
    return join_on(ra, quantiles(rows, ["key"], "dec", [0.5]).select("key", F.col("q")[0].alias("dec")), ["key"])


def confirmed(aliases: DataFrame, places: DataFrame, cone_deg: float = CONE_DEG) -> DataFrame:
    """key, to, separation, accepted: an alias is refused if both sides have a place (key, ra, dec) and lie farther apart than the cone."""
    side = lambda c, a: places.select(F.col("key").alias(c), F.col("ra").alias(f"ra_{a}"), F.col("dec").alias(f"dec_{a}"))
    both = aliases.select("key", "to").join(side("key", "a"), "key", "left").join(side("to", "b"), "to", "left")
    apart = separation_deg(F.col("ra_a"), F.col("dec_a"), F.col("ra_b"), F.col("dec_b"))
    return both.select("key", "to", apart.alias("separation")).withColumn("accepted", F.coalesce(F.col("separation") <= cone_deg, F.lit(True)))


def alias_groups(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """raw, key, n, display: each distinct raw name (raw, key, n) with the end of its key's chain, and the raw name that its group has most of (of
    equals the least)."""
    ends = followed(aliases)
    keyed = names.join(ends, "key", "left").select("raw", F.coalesce("to", "key").alias("key"), "n")
    shown = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), "raw")).alias("b")).select("key", F.col("b.raw").alias("display"))
    return keyed.join(shown, "key", "left").select("raw", "key", "n", "display")
