"""Canonical choice within groups of equal records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_rows(df: DataFrame, keys: list[Column], order: list[Column], carry: list[str]) -> DataFrame:
    """One row per group of equal keys: the least by `order`, with the group's size.

    The choice is an aggregate (`min` of a struct), not a window, so that copies are
    combined before the shuffle and no task has to hold a group. NULL keys are equal.
    """
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    grouped = df.select(*named, ranked.alias("_r")).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_r").alias("_r"), F.count(F.lit(1)).alias("group_size"))
    return grouped.select(*[F.col(f"_r._c{i}").alias(c) for i, c in enumerate(carry)], "group_size")
