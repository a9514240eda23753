"""Thresholds and aliases of noise alone on the driver's events, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import nulls as X
from seriesforge.plans.base import query
from seriesforge.plans.fits import days


def hash_sql(key: str, what: str) -> str:
    return f"CAST('0x' || substr(md5('0|' || {key} || '|' || trial || '|{what}'), 1, 8) AS BIGINT)"


def trials_sql(trials: int, each_star: bool = False, star: str = "user_id % 7") -> str:
    """CTE z: key, trial, t, y of moved series."""
    group, name = ("event_type, star", "event_type || '|' || star") if each_star else ("event_type", "event_type")
    return f"""r AS (SELECT event_type, {star} AS star, epoch_us(ts) / 86400000000.0 - 19723 AS t, CAST(value AS DOUBLE) AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type, {star}) AS n FROM events WINDOW w AS (PARTITION BY event_type, {star} ORDER BY ts, event_id)),
            s AS (SELECT event_type, star, any_value(n) AS n FROM r GROUP BY 1, 2 HAVING any_value(n) >= 5), o AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY star) - 1 AS s, count(*) OVER (PARTITION BY {group}) AS m FROM s),
            d AS (SELECT {group}, trial, {hash_sql(name, 'star')} % m AS s, {hash_sql(name, 'shift')} AS h FROM o, (SELECT unnest(range({trials})) AS trial) WHERE s = 0), c AS (SELECT o.event_type, o.star, trial, h % n AS step, n FROM d JOIN o USING ({group}, s)),
            v AS (SELECT r.event_type, r.star, trial, y, (i + step) % r.n AS i FROM r JOIN c USING (event_type, star)), z AS (SELECT v.event_type, v.star, trial, r.t, v.y FROM v JOIN r USING (event_type, star, i))"""


def peaks_sql(keys: str, low: float, high: float, n: int, y: str = "y") -> str:
    """CTE h: keys, trial, f, power of the highest peaks of z."""
    return f"""a AS (SELECT {keys}, trial, k, {low} + k * ({high - low} / {max(1, n - 1)}) AS f, avg(yy) AS y, avg(c) AS c, avg(s) AS s, avg(yy * yy) AS yy, avg(yy * c) AS yc, avg(yy * s) AS ys, avg(c * c) AS cc, avg(c * s) AS cs FROM (
            SELECT *, {y} AS yy, cos(2 * pi() * ({low} + k * ({high - low} / {max(1, n - 1)})) * t) AS c, sin(2 * pi() * ({low} + k * ({high - low} / {max(1, n - 1)})) * t) AS s FROM z, (SELECT unnest(range({n})) AS k)) GROUP BY ALL),
            b AS (SELECT {keys}, trial, k, f, yy - y * y AS yy, yc - y * c AS yc, ys - y * s AS ys, cc - c * c AS cc, cs - c * s AS cs, 1 - cc - s * s AS ss FROM a), p AS (SELECT {keys}, trial, k, f, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)) AS power FROM b WHERE yy * (cc * ss - cs * cs) <> 0),
            h AS (SELECT {keys}, trial, max(power) AS power, max_by(f, (power, -k)) AS f FROM p GROUP BY ALL)"""


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).select("event_type", (F.col("user_id") % 7).alias("star"), "x", "event_id", F.col("value").cast("double").alias("y"))


@query(f"WITH {trials_sql(40)}, {peaks_sql('event_type', 0.6, 2.6, 21)} SELECT event_type, count(*) AS trials, round(quantile_cont(power, 0.95), 6) AS threshold, round(quantile_cont(power, 0.95 - 1.96 * sqrt(0.95 * 0.05 / 40)), 6) AS low, round(quantile_cont(power, least(1.0, 0.95 + 1.96 * sqrt(0.95 * 0.05 / 40))), 6) AS high FROM h GROUP BY 1")
def detection_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.detection_thresholds(noise(spark, sf_dir), ["event_type"], "star", "x", "event_id", "y", 0.6, 2.6, 21, 40, 0.05)
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", "low", "high")})


@query(f"WITH {trials_sql(10, True)}, {peaks_sql('event_type, star', 1.3, 1.3, 1)}, q AS (SELECT event_type, star, quantile_cont(power, 0.9) AS q FROM h GROUP BY 1, 2) SELECT event_type, count(*) AS stars, round(min(q), 6) AS lowest, round(max(q), 6) AS highest, round((max(q) - min(q)) / quantile_cont(q, 0.5), 4) AS spread FROM q GROUP BY 1")
def threshold_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At one frequency, star by star."""
    out = X.threshold_spread(noise(spark, sf_dir), ["event_type"], "star", "x", "event_id", "y", 1.3, 1.3, 1, 10, 0.1)
    return out.select("event_type", "stars", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"), F.round("spread", 4).alias("spread"))


@query(f"""WITH {trials_sql(20)}, {peaks_sql('event_type', 0.25, 4.25, 81, f"y + 40 * sin(2 * pi() * (t * 1.25 + {hash_sql('event_type', 'phase')} / 4294967296.0))")},
            g AS (SELECT event_type, abs(f - 1.25) <= 0.025 AS hit, list_has_any([true], list_transform([-3, -2, -1, 1, 2, 3], lambda k: abs(f - abs(1.25 + k)) <= 0.025)) AS al FROM h)
            SELECT event_type, count(*) AS trials, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS "true", round(avg(CASE WHEN NOT hit AND al THEN 1.0 ELSE 0 END), 6) AS alias, round(avg(CASE WHEN NOT hit AND NOT al THEN 1.0 ELSE 0 END), 6) AS other FROM g GROUP BY 1""")
def alias_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.alias_confusion(noise(spark, sf_dir), ["event_type"], "star", "x", "event_id", "y", 0.8, 40.0, 0.25, 4.25, 81, 20)
    return out.withColumns({c: F.round(c, 6) for c in ("true", "alias", "other")})


@query(f"""WITH {trials_sql(10, star='0')}, a AS (SELECT event_type, amp, trial, cos(2 * pi() * t) AS c, sin(2 * pi() * t) AS s, y + amp * sin(2 * pi() * (t + {hash_sql('event_type', 'phase')} / 4294967296.0)) AS v FROM z, (SELECT unnest([5.0, 20.0, 80.0]) AS amp)),
            b AS (SELECT event_type, amp, trial, var_pop(c) AS cc, var_pop(s) AS ss, covar_pop(c, s) AS cs, covar_pop(v, c) AS yc, covar_pop(v, s) AS ys FROM a GROUP BY 1, 2, 3), f AS (SELECT event_type, amp, sqrt(pow((yc * ss - ys * cs) / (cc * ss - cs * cs), 2) + pow((ys * cc - yc * cs) / (cc * ss - cs * cs), 2)) AS fitted FROM b)
            SELECT event_type, CAST(amp AS DOUBLE) AS amplitude, count(*) AS trials, count(*) FILTER (abs(fitted - amp) <= amp / 3) AS recovered FROM f GROUP BY 1, 2""")
def injected_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = days(spark, sf_dir).select("event_type", F.lit(0).alias("star"), "x", "event_id", F.col("value").cast("double").alias("y"))
    return X.injection_recovery(e, ["event_type"], "star", "x", "event_id", "y", 1.0, [5.0, 20.0, 80.0], 10)
