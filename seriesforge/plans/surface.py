"""Column functions over the driver's tables: names, times, units, templates, verdict ladders. Inputs are derived by expressions
that both engines read alike; the functions and the SQL of each query are written independently."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions import photometry as P
from seriesforge.functions import scalars as S
from seriesforge.functions import verdicts as V
from seriesforge.operators import robust as R
from seriesforge.plans.base import query
from seriesforge.sources.tables import read_table

c = F.col


def source(table: str, columns: dict[str, str]) -> str:
    return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table})"


def derived(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return read_table(spark, sf_dir, table).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def rounded(columns: dict, digits: int = 6) -> list:
    return [F.round(v, digits).alias(k) for k, v in columns.items()]


FILES = {
    "id": "p_partkey",
    "path": "concat('/arch/', p_brand, '/', CASE p_partkey % 6 WHEN 0 THEN 'img_' WHEN 1 THEN 'Master-dark-flat-' WHEN 2 THEN 'ha.flat3_' WHEN 3 THEN 'master_flat_g_' WHEN 4 THEN 'g.Flat-light-' ELSE 'kaf_0p25s_' END, CAST(p_partkey AS VARCHAR(9)), CASE p_partkey % 5 WHEN 0 THEN '_calibrated_wcs_1' WHEN 1 THEN '_cal' WHEN 2 THEN '_wcs_12' WHEN 3 THEN '_12' ELSE '' END, CASE p_partkey % 4 WHEN 0 THEN '.fits.fz' WHEN 1 THEN '.FIT' WHEN 2 THEN '.fts.GZ' ELSE '.fits' END)",
    "imagetyp": "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Bias Frame' WHEN 2 THEN ' Dark Frame ' WHEN 3 THEN 'FLAT' WHEN 4 THEN '' ELSE 'Light Frame' END",
    "band": "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' G ' WHEN 2 THEN 'ha' WHEN 3 THEN '' ELSE 'Clear' END",
    "exptime": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.25 WHEN 2 THEN 30.0 ELSE 0.0 END",
    "nights": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '2024-05-02' WHEN 2 THEN '2024-05-02+2024-05-03' ELSE '2024-05-31+2024-06-01' END",
    "size": "p_size",
}


@query(f"""WITH f AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM {source("part", FILES)}), g AS (SELECT *, regexp_replace(base, '(?i)\\.(fz|gz)$', '') AS plain, lower(base) AS low, trim(coalesce(imagetyp, '')) AS it FROM f),
            h AS (SELECT *, CASE WHEN it = 'Bias Frame' THEN 'bias' WHEN it = 'Dark Frame' THEN 'dark' WHEN it IN ('Flat Field', 'FLAT') THEN 'flat' WHEN starts_with(low, 'master') THEN CASE WHEN contains(low, 'bias') THEN 'bias' WHEN contains(low, 'dark') THEN 'dark' WHEN contains(low, 'flat') THEN 'flat' END
                WHEN regexp_matches(low, '^[a-z]{{1,3}}\\.flat[0-9]') OR contains(low, 'flat-light') THEN 'flat' END AS kind, TRY_CAST(replace(nullif(regexp_extract(base, '_([0-9]+(p[0-9]+)?)s[_.]', 1), ''), 'p', '.') AS DOUBLE) AS token FROM g)
            SELECT id, base, plain, regexp_replace(plain, '(?i)\\.(fits|fit|fts)$', '') AS stem, regexp_replace(regexp_replace(plain, '(?i)\\.(fits|fit|fts)$', ''), '((_(calibrated|cal|wcs))(_[0-9]{{1,2}})?)+$', '') AS reduced, starts_with(low, 'master') AS is_master, kind,
                kind IS NULL AND (it = '' OR starts_with(lower(it), 'light')) AS science, CASE WHEN starts_with(low, 'master') THEN 'master_' || kind ELSE kind END AS role, lower(trim(coalesce(band, ''))) AS band_key,
                id || '|e' || size || '|' || CASE WHEN trim(coalesce(band, '')) <> '' THEN trim(band) ELSE 'none' END AS series, base || '|' || size || '.0' AS dup, token,
                CASE WHEN exptime IS NULL OR exptime <= 0 THEN coalesce(token, exptime) WHEN token > 0 AND abs(exptime - token) > 0.2 * greatest(exptime, token) THEN token ELSE exptime END AS effective,
                CASE WHEN exptime IS NULL THEN '?s' WHEN exptime = 0.25 THEN '0.25s' WHEN exptime = 30 THEN '30s' ELSE '0s' END AS label, regexp_replace(lower(coalesce(nullif(trim(band), ''), '(blank)')), '[^a-z0-9]+', '_', 'g') AS slug,
                '/root/' || ltrim(path, '/') AS full_path, regexp_replace(regexp_replace(path, '(?i)\\.(fz|gz)$', ''), '(?i)\\.(fits|fit|fts)$', '') || '.wcs' AS sidecar, split_part(coalesce(nights, ''), '+', 1) AS night,
                CASE WHEN nights IS NULL THEN '' WHEN length(nights) = 10 THEN nights WHEN substr(nights, 1, 7) = substr(nights, 12, 7) THEN substr(nights, 1, 10) || '+' || substr(nights, 20, 2) ELSE nights END AS scope, coalesce(length(nights) > 10, false) AS several FROM h""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems, kinds, keys, exposure tokens and night labels of file names."""
    d = derived(spark, sf_dir, "part", FILES)
    kind, master = V.calib_kind("imagetyp", "path"), S.is_master("path")
    return d.select(
        "id", S.basename_of("path").alias("base"), S.strip_compression(S.basename_of("path")).alias("plain"), S.frame_stem("path").alias("stem"), S.reduced_stem("path").alias("reduced"), master.alias("is_master"), kind.alias("kind"),
        V.is_science("imagetyp", kind).alias("science"), V.calib_role(kind, master).alias("role"), S.norm_filter("band").alias("band_key"), S.series_key("id", "size", "band").alias("series"), S.dup_key("path", "size", "id").alias("dup"),
        V.exposure_token(S.basename_of("path")).alias("token"), V.effective_exposure("exptime", S.basename_of("path")).cast("double").alias("effective"), V.compact_seconds("exptime").alias("label"), V.table_slug(V.mode_label("band")).alias("slug"),
        V.archive_path("/root", "path").alias("full_path"), V.sidecar_path("path").alias("sidecar"), V.run_night(F.lit(None), "nights").alias("night"), V.run_scope("nights", F.lit(None)).alias("scope"), V.is_multi_night("nights", "nights").alias("several"),
    )


TIMES = {
    "id": "event_id",
    "mode": "CASE event_id % 3 WHEN 0 THEN 'High StackPro' WHEN 1 THEN NULL ELSE 'Mode0' END",
    "jd": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 2460000.0 + CAST(event_id % 997 AS DOUBLE) / 8 END",
    "exptime": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE CAST(event_id % 240 AS DOUBLE) END",
    "stamp": "CASE event_id % 4 WHEN 0 THEN 'junk' WHEN 1 THEN '2024-02-29T06:00:00' WHEN 2 THEN '2024-02-29T06:00:00.5' ELSE NULL END",
    "printed": "CASE event_id % 4 WHEN 0 THEN '0.07908912' WHEN 1 THEN '12' WHEN 2 THEN '1.25e-3' ELSE NULL END",
    "x": "CAST(event_id % 1000 AS DOUBLE) / 100",
}


@query(f"""WITH m AS (SELECT *, CASE WHEN jd IS NULL THEN 'no_jd' WHEN exptime IS NULL OR exptime <= 0 THEN 'exptime_nonpos_start_used' WHEN contains(lower(mode), 'stackpro') THEN 'stackpro_sum_midpoint_half_exptime' ELSE 'start_plus_half_exptime' END AS method FROM {source("events", TIMES)})
            SELECT id, method, round(jd + CASE WHEN exptime > 0 THEN exptime / 172800 ELSE 0 END, 6) AS mid, CASE WHEN contains(lower(mode), 'stackpro') THEN CAST(5.675 AS DOUBLE) ELSE 0 END AS worst, CASE id % 4 WHEN 1 THEN 2460369.75 WHEN 2 THEN round(2460369.75 + 0.5 / 86400, 8) END AS parsed,
            round(jd - 2400000.5, 6) AS mjd, round(jd, 6) AS back, CAST(DATE '1970-01-01' + CAST(floor(jd - 2440587.5) AS INTEGER) AS DATE) AS utc_night, CAST(DATE '1970-01-02' + CAST(floor(jd - 2440587.5) AS INTEGER) AS DATE) AS next_night, CAST(floor(jd - 2440587.5) AS INTEGER) - 19000 AS days,
            CASE id % 4 WHEN 0 THEN 5e-9 WHEN 2 THEN 0.005 END AS printed_sigma, round(CASE WHEN exptime IS NULL THEN NULL WHEN exptime <= 0 THEN 0 ELSE round(exptime / pow(10, floor(log10(exptime)) - 2)) * pow(10, floor(log10(exptime)) - 2) END, 6) AS exposure FROM m""")
def time_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir, "events", TIMES)
    return d.select(
        "id", V.mid_method("mode", "jd", "exptime").alias("method"), F.round(V.mid_jd("jd", "exptime"), 6).alias("mid"), V.worst_mid_error_s("mode").alias("worst"), F.round(P.jd_of_text("stamp"), 8).alias("parsed"), F.round(S.jd_to_mjd("jd"), 6).alias("mjd"),
        F.round(S.mjd_to_jd(S.jd_to_mjd("jd")), 6).alias("back"), S.night_label("jd", 0.0).alias("utc_night"), P.next_date(S.night_label("jd", 0.0)).alias("next_night"), P.days_between(S.night_label("jd", 0.0), F.date_add(F.lit("1970-01-01").cast("date"), 19000)).alias("days"),
        P.printed_sigma("printed").alias("printed_sigma"), F.round(S.exposure_bin("exptime"), 6).alias("exposure"),
    )


UNITS = {
    "id": "p_partkey",
    "flux": "CASE WHEN p_partkey % 13 = 0 THEN 0.0 ELSE CAST(p_retailprice AS DOUBLE) END",
    "err": "CAST(p_size AS DOUBLE) + 1",
    "expo": "CASE WHEN p_partkey % 17 = 0 THEN 0.0 ELSE CAST(p_partkey % 60 AS DOUBLE) + 1 END",
    "alt": "CAST(p_partkey % 100 AS DOUBLE) - 5",
    "scale": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 9 AS DOUBLE) / 4 END",
    "n": "p_partkey % 50",
}


@query(f"""WITH u AS (SELECT *, flux / nullif(expo, 0) AS rate, CASE WHEN alt > 0 THEN 1 / (sin(radians(alt)) + 0.50572 * pow(alt + 6.07995, -1.6364)) END AS x FROM {source("part", UNITS)})
            SELECT id, round(CASE WHEN rate > 0 THEN 25 - 2.5 * log10(rate) END, 6) AS mag, round(CASE WHEN flux > 0 THEN 1.0857 * err / flux END, 6) AS mag_err, round(x, 6) AS airmass, round(2.3548200450309493 * sqrt((err * err + 4) / 2), 6) AS fwhm, round(2.3548200450309493 * sqrt((err * err + 4) / 2) * scale, 6) AS fwhm_arcsec,
            round(CASE WHEN scale > 0 THEN least(greatest(4 / scale, 2), 30) END, 6) AS aperture, greatest(0.8 * err, 2) AS tolerance, round(sqrt(err * err + 16), 6) AS quad, round(CASE WHEN err * err >= 100 THEN sqrt(err * err - 100) END, 6) AS excess, round(pow(10, 0.4 * (15 - err / 10)), 6) AS passed,
            round(CASE WHEN flux > 0 THEN 1.0857 * sqrt(flux / 1.5 + 50 * err * err + 50 * err * err / 5) / flux END, 6) AS sigma, round(CASE WHEN x >= 1 AND expo > 0 THEN 0.09 * pow(50, -2.0 / 3) * pow(x, 1.75) * exp(-1515 / 8000.0) / sqrt(2 * expo) END, 8) AS scint, round((1 - cos(radians(alt))) / 2, 6) AS lit,
            round(1 - 2 / err, 6) AS ellipt, round(CASE WHEN flux > 0 AND expo > 0 THEN -2.5 * log10(flux / expo) + 25 - 0.5 END, 6) AS limit_mag, 3 * err AS limit_flux, round(0.01 * sqrt(72 / nullif(n, 0)), 6) AS amin, round(sqrt(0.25 / nullif(n, 0)), 6) AS duty,
            round(sqrt(0.0004 + 0.0001 + pow(0.001 * expo, 2)), 6) AS colour, round(206.265 * err / 100, 6) AS plate, round(sqrt(abs(err * err + 4)) * 3600, 4) AS plate_cd, round(sqrt(pow(err * 10, 2) + pow(err * 20, 2)) / 2 * radians(scale / 3600) * 499.00478, 6) AS light_s, round(100 * n / err, 6) AS pct, round(n * 4.3 / 10 / 3600, 8) AS hours FROM u""")
def unit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir, "part", UNITS).withColumn("x", S.airmass("alt"))
    two, expo = F.lit(2.0), F.nullif(c("expo"), F.lit(0.0))
    return d.select(
        "id",
        *rounded({
            "mag": S.instrumental_mag("flux", expo), "mag_err": S.mag_error("flux", "err"), "airmass": c("x"), "fwhm": S.fwhm_from_axes("err", two), "fwhm_arcsec": S.fwhm_from_axes("err", two) * c("scale"), "aperture": P.aperture_radius("scale"), "tolerance": P.match_tolerance("err"),
            "quad": S.quadrature("err", F.lit(4.0)), "excess": S.quadrature_excess("err", F.lit(10.0)), "passed": S.transmission(c("err") / 10, F.lit(15.0)), "sigma": P.predicted_sigma("flux", F.lit(50.0), "err", F.lit(1.5)), "lit": P.illuminated_fraction("alt"), "ellipt": P.ellipticity("err", two),
            "limit_mag": P.limit_magnitude("flux", "expo", F.lit(0.5)), "limit_flux": P.limit_flux("err"), "amin": P.least_amplitude(F.lit(0.01), "n"), "duty": P.duty_sigma("n"), "colour": P.colour_sigma(F.lit(0.02), F.lit(0.01), F.lit(0.001), "expo"), "plate": P.plate_scale("err", F.lit(100.0)),
            "light_s": P.light_time_corner_s(c("err") * 10, c("err") * 20, "scale"), "pct": P.percent("n", "err"),
        }),
        F.round(P.scintillation("x", "expo", 50.0, 1515.0), 8).alias("scint"), F.round(P.plate_scale_cd("err", two, -two, "err"), 4).alias("plate_cd"), F.round(P.projected_hours("n", F.lit(4.3), 10), 8).alias("hours"),
    )


@query(f"""WITH t AS (SELECT *, (x - 0.25) / 0.37 + 0.5 AS q, (x - 0.25 + 0.185) / 0.37 AS b FROM {source("events", TIMES)}), u AS (SELECT *, abs(q - floor(q) - 0.5) AS away, (b - floor(b)) * 0.37 - 0.185 AS dt FROM t)
            SELECT id, round(0.2 * sin(2 * pi() * (x / 0.37 + 0.1)), 6) AS wave, round(least(greatest((x - 5) / 0.5 + 0.5, 0), 1), 6) AS ramp, round(0.8 * least(greatest((0.06 - away) / 0.02, 0), 1), 6) AS dip, round(-1.5 * least(greatest((dt + 0.074) / 0.02 + 0.5, 0), 1) * least(greatest((0.074 - dt) / 0.02 + 0.5, 0), 1), 6) AS bright,
            round((x / 3 - 0.2 + 0.5) - floor(x / 3 - 0.2 + 0.5) - 0.5, 6) AS wrapped, round(x / 0.37 * 1e-5 / 0.37, 9) AS drift, round(abs((x - 1) / 0.37) * 0.01 / 0.37, 9) AS smear, abs((x - 1) / 0.37) * 0.01 / 0.37 < 0.5 AS countable, round(CASE WHEN x > 0 THEN sqrt(6.0 / 100) * 0.02 / (pi() * x * 0.1) * 0.1369 END, 9) AS period_sigma,
            round((x * x - 4) / nullif(sqrt(pow(2 * x * 0.1, 2) + pow(2 * 2 * 0.2, 2)), 0), 6) AS excess_z, round(x / sqrt(2 * 40.0), 6) AS sf_sigma, CASE WHEN abs(x - 3.3) <= 0.066 THEN 'true' WHEN abs(x - 0.3) <= 0.066 OR abs(x - 1.3) <= 0.066 OR abs(x - 2.3) <= 0.066 OR abs(x - 4.3) <= 0.066 OR abs(x - 5.3) <= 0.066 OR abs(x - 6.3) <= 0.066 THEN 'alias' ELSE 'other' END AS peak,
            round((x + 0.1) / 1.1, 6) AS solved, round(sqrt((x * x * 0.01 + 4 * 0.04 + 2 * x * 2 * 0.001) / (x * x + 4)), 6) AS amp_sigma, round(abs(x - 3), 6) AS third_alias FROM u""")
def template_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    ambiguity = P.cycle_ambiguity("x", lit(1.0), lit(0.37), lit(0.01))
    return derived(spark, sf_dir, "events", TIMES).select(
        "id",
        *rounded({
            "wave": P.sinusoid("x", 0.37, 0.2, 0.1), "ramp": P.ramp("x", 5.0, 0.5), "dip": P.eclipse("x", 0.37, 0.8, 0.1, 0.25, 0.02), "bright": P.bright_phase("x", 0.37, 0.25, 1.5, 0.4, 0.02), "wrapped": P.phase_difference(c("x") / 3, lit(0.2)),
            "excess_z": P.excess_significance("x", lit(0.1), lit(2.0), lit(0.2)), "sf_sigma": P.structure_sigma("x", lit(90), lit(40)), "solved": P.colour_solve("x", lit(0.3), lit(0.2), lit(1.0)), "amp_sigma": P.amplitude_sigma("x", lit(2.0), lit(0.01), lit(0.04), lit(0.001)),
            "third_alias": F.element_at(P.alias_family("x"), 1)["f"],
        }),
        F.round(P.phase_drift("x", lit(0.37), lit(1e-5)), 9).alias("drift"), F.round(ambiguity["drift"], 9).alias("smear"), ambiguity["unique"].alias("countable"), F.round(P.least_squares_period_sigma(lit(100), "x", lit(0.1), lit(0.02), lit(0.37)), 9).alias("period_sigma"),
        V.peak_class("x", lit(3.3)).alias("peak"),
    )


LADDER = {
    "id": "o_orderkey",
    "n": "o_orderkey % 19",
    "m": "o_orderkey % 7",
    "x": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 400 AS DOUBLE) / 100 END",
    "y": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 170 AS DOUBLE) / 50 END",
    "flag": "o_orderkey % 3 = 0",
    "word": "CASE o_orderkey % 5 WHEN 0 THEN 'wcs' WHEN 1 THEN 'bound' WHEN 2 THEN ' ' WHEN 3 THEN NULL ELSE 'dispersed' END",
    "day": "CASE o_orderkey % 3 WHEN 0 THEN '2023-05-05' WHEN 1 THEN '2023-06-01' ELSE '2024-01-01' END",
}


@query(f"""SELECT id, CASE WHEN n <= 0 THEN 'none' WHEN n < 12 THEN 'too few' ELSE 'admitted' END AS admission, CASE WHEN n <= 0 OR m <= 0 THEN 'undetected' WHEN m >= 5 THEN 'measured' ELSE 'sparse' END AS target, CASE WHEN m >= 3 THEN 'validated' WHEN m > 0 THEN 'weak' ELSE 'unvalidated' END AS checked,
            CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN 3 - x >= 1 THEN 'OUTBURST' WHEN 3 - x <= 0.6 THEN 'QUIESCENT' ELSE 'ELEVATED' END AS night, CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN x < 2 - coalesce(y, 0) THEN 'HIGH' WHEN x > 2 + coalesce(y, 0) THEN 'LOW' ELSE 'INTERMEDIATE' END AS state,
            CASE WHEN x IS NULL THEN 'unknown' WHEN x BETWEEN 1 AND 2 THEN 'inside-core' WHEN x BETWEEN 0.5 AND 3 THEN 'inside-span' ELSE 'extrapolated' END AS colour, round(CASE WHEN x < 0.5 THEN (0.5 - x) * 0.12 WHEN x > 3 THEN (x - 3) * 0.12 WHEN x IS NOT NULL THEN 0 END, 6) AS reach,
            CASE WHEN n < 8 OR NOT flag THEN 'UNTIED' WHEN m < 4 OR y IS NULL THEN 'TIED-UNVERIFIED' WHEN y / 100 <= 0.01 THEN 'TIED-STRETCH' WHEN y / 100 <= 0.02 THEN 'TIED-GOAL' ELSE 'TIED-ABOVE-GOAL' END AS block, CASE WHEN n = 18 AND m = 18 THEN 'SUPPORTED' WHEN n = 18 THEN 'SUPPORTED-WITH-CAVEATS' WHEN n = 0 THEN 'NOT SUPPORTED' ELSE 'PARTIALLY SUPPORTED' END AS goal,
            CASE WHEN x IS NULL THEN 'unknown' WHEN x BETWEEN 1 AND 2 THEN 'inside' WHEN x BETWEEN 0.5 AND 2.5 THEN 'near' ELSE 'outside' END AS literature, coalesce(x <= 1.5, false) AS risk, CASE WHEN x > 0 AND -2.5 * log10(x) >= 0.5 THEN 'attenuated' WHEN x > 0 AND abs(-2.5 * log10(x)) <= 0.2 THEN 'clear' ELSE '' END AS sky,
            CASE WHEN n >= m THEN CASE WHEN n >= 10 THEN 'ok' WHEN n > 0 THEN 'partial' WHEN m > 0 THEN 'master_only' ELSE 'missing' END ELSE CASE WHEN n >= 10 THEN 'ok' WHEN n > 0 THEN 'partial' WHEN m > 0 THEN 'master_only' ELSE 'missing' END END AS cell, 'dark' || CASE WHEN coalesce(word, '') <> '' THEN ' ' || word ELSE '' END || ' x >=10 (have ' || n || ')' AS gap FROM {source("orders", LADDER)}""")
def series_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    return derived(spark, sf_dir, "orders", LADDER).select(
        "id", V.series_admission("n").alias("admission"), V.target_verdict("n", "m", 5).alias("target"), V.check_verdict("m").alias("checked"), V.night_state("x", lit(3.0)).alias("night"), S.classify_state("x", 2.0, "y").alias("state"),
        V.colour_position("x", lit(0.5), lit(3.0), lit(1.0), lit(2.0)).alias("colour"), F.round(V.colour_reach_error("x", lit(0.5), lit(3.0), lit(-0.1), lit(0.02)), 6).alias("reach"), V.block_verdict("n", "m", c("y") / 100, "flag").alias("block"), V.goal_verdict("n", "m", lit(18)).alias("goal"),
        V.range_check("x", lit(1.0), lit(2.0), 0.5).alias("literature"), V.bright_limit_risk("x", lit(1.5)).alias("risk"), V.transmission_label("x", 0.2, 0.5).alias("sky"), V.coverage_cell("n", "m", lit(10)).alias("cell"), V.gap_spec(lit("dark"), "word", "n", lit(10)).alias("gap"),
    )


@query(f"""SELECT id, CASE WHEN y < 1.5 THEN 'AMPLITUDE ONLY' WHEN x IS NULL OR y IS NULL THEN 'UNTESTED' WHEN x >= 2 AND y > 2.5 THEN 'DETECTED' WHEN x >= 2 OR y > 2.5 THEN 'MARGINAL' ELSE 'NOT DETECTED' END AS detection, CASE WHEN x IS NULL OR y IS NULL THEN 'UNTESTED' WHEN x <= y THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END AS capability,
            greatest(12 - n, 0) AS shortfall, round(greatest(12 - n, 0) / nullif(CAST(m AS DOUBLE), 0), 6) AS seasons, round(y / nullif(x, 0), 6) AS ratio, coalesce(y / nullif(x, 0) >= 5, false) AS passes, round((x - 1) / nullif(sqrt(pow(coalesce(y, 0), 2)), 0), 6) AS deviation, coalesce(abs(x - 1) / nullif(coalesce(y, 0), 0) <= 3, false) AS agrees,
            CASE WHEN x IS NULL THEN 'UNRESOLVED' WHEN x < 0.2 THEN 'DATA' WHEN n <= 1 THEN 'SINGLE-NIGHT' WHEN NOT flag THEN 'UNRESOLVED' ELSE 'PRIOR' END AS family, CASE WHEN n >= 8 AND m > 3 THEN 'unchanged_in' WHEN n >= 8 THEN 'moved_out' WHEN m > 3 THEN 'moved_in' ELSE 'unchanged_out' END AS movement,
            CASE WHEN x IS NULL THEN 'UNTESTED' WHEN x / 4 >= 0.9 THEN 'RECOVERED' ELSE 'LOST' END AS contour, coalesce(word <> ' ' AND word IN ('wcs', 'bound'), false) AS listed FROM {source("orders", LADDER)}""")
def decision_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    need, gate, agree = V.nights_needed("n", lit(12), c("m").cast("double")), V.snr_gate("x", "y"), V.agreement_test("x", "y", lit(1.0), lit(None).cast("double"))
    return derived(spark, sf_dir, "orders", LADDER).select(
        "id", V.detection_call("x", lit(2.0), "y", lit(2.5), "y").alias("detection"), V.capability("x", "y", False).alias("capability"), need["shortfall"].alias("shortfall"), F.round(need["seasons"], 6).alias("seasons"), F.round(gate["ratio"], 6).alias("ratio"), gate["passes"].alias("passes"),
        F.round(agree["deviation"], 6).alias("deviation"), agree["agrees"].alias("agrees"), V.family_choice("n", "x", "flag").alias("family"), S.gate_movement(c("n") >= 8, c("m") > 3).alias("movement"), V.contour_reached(c("x") / 4).alias("contour"), S.passes_list("word", allowed=["WCS", "Bound"]).alias("listed"),
    )


@query(f"""WITH l AS (SELECT *, CASE WHEN n = 0 THEN 'unreadable' WHEN x > 3.5 THEN 'defocused' WHEN n < 5 THEN 'starved' WHEN y > 1.8 THEN 'trailing' WHEN m > 5 THEN 'saturated' ELSE 'unexplained' END AS why FROM {source("orders", LADDER)})
            SELECT id, CASE WHEN x IS NULL THEN 'dimensions unknown' WHEN y IS NULL OR y <= 0 THEN 'no aperture' WHEN least(x * 100, 300) < 60 * y THEN 'does not fit' ELSE 'ok' END AS geometry, coalesce(x * 100 < 64, true) AS implausible, x IS NULL OR least(x * 100, 300) < 100 AS small, CASE WHEN flag AND m > 3 THEN 'wcs' ELSE 'stars' END AS method,
            round(n / nullif(least(m, 9.0), 0), 6) AS rate, coalesce(n >= 8 AND n / nullif(least(m, 9.0), 0) >= 0.3, false) AS matched, round(n * m * pi() * 4 / 1000.0, 6) AS chance, n >= 8 AND n >= 10 * greatest(n * m * pi() * 4 / 1000.0, 0.1) AS beats, coalesce(x + y >= 3, false) AS saturated, round(4 - coalesce(y, 0), 6) AS veto, round((4 - y) / nullif(x, 0) + 1, 6) AS reduced,
            CAST(floor(0.92 * (n * 1000 + 555) / 100) * 100 AS BIGINT) AS level, CAST(ceil(log2(n + 1)) AS INTEGER) AS bits, CAST(2800 AS BIGINT) AS reject, CASE WHEN NOT flag THEN 'bound' WHEN x <= 2 THEN 'wcs' ELSE 'wcs_off' END AS position, CASE WHEN x IS NULL THEN 'undetermined' WHEN word = 'wcs' THEN CASE WHEN x >= 3 THEN 'rejected' WHEN x >= 2 THEN 'suspect' ELSE 'clean' END WHEN x < 2 THEN 'bounded_clean' ELSE 'undetermined' END AS class,
            CASE WHEN word = 'wcs' THEN 'broadband' WHEN word = 'bound' THEN 'narrowband' ELSE 'other' END AS role, CASE WHEN day < '2023-05-20' THEN 'template_pre' WHEN day <= '2023-12-31' THEN 'campaign' ELSE 'template_post' END AS epoch, coalesce(nullif(trim(word), ''), 'unmeasured') AS dispersion, coalesce(word, '') <> 'dispersed' AS direct,
            CASE WHEN x IS NULL THEN 'n/a' WHEN x / 10 >= 0.15 THEN 'high' ELSE 'ambiguous' END AS strength, coalesce(x BETWEEN 0.5 AND 2 AND n >= 8 AND y <= 1, false) AS sane, why AS diagnosis, why = 'unexplained' AS gate,
            concat_ws(',', CASE WHEN trim(word) <> '' THEN 'header_error' END, CASE WHEN x <= 0 THEN 'exptime_nonpos' END, CASE WHEN y < 1 OR y > 10 THEN 'airmass_garbage' END, CASE WHEN x IS NULL THEN 'no_jd' END, CASE WHEN y IS NULL THEN 'no_coords' END, CASE WHEN word IS NULL THEN 'blank_target' END, CASE WHEN x > 1 THEN 'pointing_gt1deg' END) AS flags FROM l""")
def frame_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    d = derived(spark, sf_dir, "orders", LADDER)
    wide, chance = c("x") * 100, V.chance_matches("n", "m", lit(2.0), lit(1000.0))
    diagnosis = V.diagnose(F.when(c("n") > 0, c("n")), F.when(c("n") >= 5, lit(20)).otherwise(lit(3)), "y", F.when(c("m") > 5, lit(0.5)).otherwise(lit(0.0)), F.when(c("x") > 3.5, lit(9.0)).otherwise(lit(2.0)))
    return d.select(
        "id", V.geometry_verdict(wide, F.when(c("x").isNotNull(), lit(300.0)), c("y") * 10).alias("geometry"), V.is_implausible(wide, lit(300)).alias("implausible"), V.is_window(wide, lit(300.0), 100).alias("small"), V.registration_method("flag", c("m") > 3).alias("method"),
        F.round(V.match_rate("n", "m", lit(9.0)), 6).alias("rate"), V.wcs_match_ok("n", "m", lit(9.0)).alias("matched"), F.round(chance, 6).alias("chance"), V.beats_chance("n", chance).alias("beats"), V.is_saturated("x", "y", lit(3.0)).alias("saturated"),
        F.round(V.applied_veto(lit(4.0), "y"), 6).alias("veto"), F.round(V.reduced_veto(lit(4.0), "x", "y", lit(1.0)), 6).alias("reduced"), V.veto_level(c("n") * 1000 + 555).alias("level"), V.bits_of("n").alias("bits"), V.screen(lit(3500), 0.8).alias("reject"),
        V.position_quality("x", "flag", 2.0).alias("position"), V.saturation_class("x", "word", lit(2.0), lit(3.0)).alias("class"), V.band_role("word", ["wcs"], ["bound"]).alias("role"), V.epoch_role("day", "2023-05-20", "2023-12-31").alias("epoch"), V.dispersion_class("word").alias("dispersion"),
        V.is_direct_image("word").alias("direct"), V.strength("x", lit(10.0)).alias("strength"), V.solution_sane("x", "n", "y", lit(0.5), lit(2.0), 8, 1.0).alias("sane"), diagnosis.alias("diagnosis"), V.qc_pregate(diagnosis).alias("gate"),
        V.qc_flags("word", "x", "y", "x", "y", "word", "x").alias("flags"),
    )


SKY = {"id": "vec_id", "label": "label", "ra": "90 + 60 * CAST({e1} AS DOUBLE)", "dec": "40 * CAST({e2} AS DOUBLE)", "pa": "360 * CAST({e3} AS DOUBLE)"}
SKY_SQL = f"(SELECT {', '.join(f'{e} AS {n}' for n, e in SKY.items())} FROM embeddings)".format(e1="embedding[1]", e2="embedding[2]", e3="embedding[3]")


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").selectExpr(*[f"{e.format(e1='embedding[0]', e2='embedding[1]', e3='embedding[2]')} AS {n}" for n, e in SKY.items()])


@query(f"""SELECT id, round(degrees(2 * asin(sqrt(least(1, pow(sin(radians(20 - dec) / 2), 2) + cos(radians(dec)) * cos(radians(20)) * pow(sin(radians(100 - ra) / 2), 2))))), 6) AS sep, round(ra, 6) AS ra_back, round(dec, 6) AS dec_back, round(ra + 3 / 3600.0 / cos(radians(dec)), 8) AS ra_moved, round(dec - 2 / 3600.0, 8) AS dec_moved,
            round(least((pa - 30) - 180 * floor((pa - 30) / 180), 180 - ((pa - 30) - 180 * floor((pa - 30) / 180))), 6) AS axis FROM {SKY_SQL} WHERE sin(radians(20)) * sin(radians(dec)) + cos(radians(20)) * cos(radians(dec)) * cos(radians(ra - 100)) > 0""")
def sky_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haversine, projection there and back, moved positions, axial distances."""
    d = sky(spark, sf_dir)
    xi, eta = S.tangent_project("ra", "dec", 100.0, 20.0)
    ra, dec = S.tangent_deproject(xi, eta, 100.0, 20.0)
    ra2, dec2 = P.shifted_position("ra", "dec", 3.0, -2.0)
    return d.select("id", *rounded({"sep": S.haversine_deg("ra", "dec", F.lit(100.0), F.lit(20.0)), "ra_back": ra, "dec_back": dec, "axis": P.axis_offset("pa", 30.0)}), F.round(ra2, 8).alias("ra_moved"), F.round(dec2, 8).alias("dec_moved")).where("ra_back is not null")


@query(f"""WITH s AS (SELECT *, max(pa - 360 * floor(pa / 360)) OVER (PARTITION BY label) - min(pa - 360 * floor(pa / 360)) OVER (PARTITION BY label) AS span, pa - 360 * floor(pa / 360) AS a FROM {SKY_SQL}), m AS (SELECT label, count(*) AS n, quantile_cont(CASE WHEN span > 180 AND a < 180 THEN a + 360 ELSE a END, 0.5) AS med, sqrt(pow(avg(cos(2 * radians(a))), 2) + pow(avg(sin(2 * radians(a))), 2)) AS coherence FROM s GROUP BY label)
            SELECT label, n, round(med - 360 * floor(med / 360), 6) AS median_deg, round(coherence, 6) AS coherence FROM m""")
def axis_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped medians and axial coherence of angles by label."""
    d = sky(spark, sf_dir).withColumn("a", F.pmod("pa", F.lit(360.0)))
    whole = d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(R.axial_coherence("a"), 6).alias("coherence"))
    return whole.join(R.wrapped_median_deg(d, ["label"], "a"), "label").select("label", "n", F.round("median_deg", 6).alias("median_deg"), "coherence")
