"""Column expressions: names, times, geometry, photometric units, verdict ladders. All stay inside codegen.

NaN never comes out of these functions: a value that can't be computed is NULL.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400.0
UNIX_EPOCH_JD = 2440587.5
LOCAL_NOON_SHIFT = 0.7917
MAG_PER_RELATIVE_FLUX = 1.0857
MAD_TO_SIGMA = 1.4826


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def finite(x) -> Column:
    """NaN and infinities become NULL, as every aggregate of this library expects."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def safe_div(a, b) -> Column:
    return F.when(col(b) != 0, col(a) / col(b))


# names and keys


def basename_of(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def strip_compression(name) -> Column:
    return F.regexp_replace(col(name), r"(?i)\.(fz|gz)$", "")


def frame_stem(name) -> Column:
    return F.regexp_replace(strip_compression(basename_of(name)), r"(?i)\.(fits|fit|fts)$", "")


def reduced_stem(name) -> Column:
    """The stem without processing suffixes; a copy counter of up to two digits goes only behind such a suffix."""
    return F.regexp_replace(frame_stem(name), r"(?:_(?:calibrated|cal|wcs)(?:_\d{1,2})?)+$", "")


def is_master(name) -> Column:
    return F.lower(basename_of(name)).startswith("master")


def norm_filter(x) -> Column:
    return F.coalesce(F.lower(F.trim(col(x))), F.lit(""))


def config_key(parts: list[Column]) -> Column:
    """One string for a NULL-safe composite key."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("∅")) for p in parts])


def series_key(target, era, band) -> Column:
    return F.concat_ws("|", col(target), F.concat(F.lit("e"), col(era).cast("string")), F.when(F.trim(col(band)) != "", F.trim(col(band))).otherwise("none"))


def parse_series_key(key) -> Column:
    parts = F.split(col(key), r"\|")
    return F.struct(F.get(parts, F.lit(0)).alias("target"), F.try_to_number(F.substring(F.get(parts, F.lit(1)), 2, 9), F.lit("999999999")).cast("int").alias("era"), F.nullif(F.get(parts, F.lit(2)), F.lit("none")).alias("band"))


def dup_key(name, when, row_id) -> Column:
    """Identity by (basename, time); a row without a time is its own group."""
    return F.when(finite(when).isNull(), F.concat(F.lit("#"), col(row_id).cast("string"))).otherwise(F.concat_ws("|", basename_of(name), finite(when).cast("string")))


def normalise_name(x) -> Column:
    """Upper case, one space for runs of separators, trailing exposure tokens ('30s', '1x60') dropped."""
    clean = F.trim(F.regexp_replace(F.upper(col(x)), r"[\s_\-#]+", " "))
    return F.regexp_replace(clean, r"(?: (?:\d+(?:\.\d+)?S|\d+X\d+(?:\.\d+)?S?))+$", "")


def rank_of(x, order: list[str]) -> Column:
    """Priority of a category; unknown ones come last."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(col(x) == name, i).otherwise(out)
    return out


def flags(named: dict[str, Column]) -> Column:
    """Names of the predicates that hold, in order, joined by commas; '' if none holds."""
    return F.concat_ws(",", *[F.when(p, F.lit(n)) for n, p in named.items()])


def first_reason(named: dict[str, Column], none: str | None = None) -> Column:
    """The first predicate that holds charges the row."""
    out = F.lit(none)
    for n, p in reversed(list(named.items())):
        out = F.when(p, F.lit(n)).otherwise(out)
    return out


# times


def jd_of(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp")) / (SECONDS_PER_DAY * 1e6) + UNIX_EPOCH_JD


def timestamp_of(jd) -> Column:
    return F.timestamp_micros(F.round((col(jd) - UNIX_EPOCH_JD) * (SECONDS_PER_DAY * 1e6)).cast("long"))


def jd_to_mjd(jd) -> Column:
    return col(jd) - 2400000.5


def mjd_to_jd(mjd) -> Column:
    return col(mjd) + 2400000.5


def night_label(jd, shift: float = LOCAL_NOON_SHIFT) -> Column:
    """Calendar date of the night from one local noon to the next."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(jd) - UNIX_EPOCH_JD - shift).cast("int"))


def mid_time(jd_start, exposure_s) -> Column:
    return col(jd_start) + col(exposure_s) / (2 * SECONDS_PER_DAY)


def phase_of(t, epoch: float, period: float) -> Column:
    x = (col(t) - epoch) / period
    return x - F.floor(x)


def fold_phase(t, epoch: float, period: float) -> Column:
    """Phase in [-0.5, 0.5)."""
    x = (col(t) - epoch) / period
    return x - F.floor(x + 0.5)


def cycle_number(t, epoch: float, period: float) -> Column:
    return F.floor((col(t) - epoch) / period)


def observed_minus_computed_s(t, epoch: float, period: float) -> Column:
    cycle = F.floor((col(t) - epoch) / period + 0.5)
    return (col(t) - (F.lit(epoch) + cycle * period)) * SECONDS_PER_DAY


def exposure_bin(x) -> Column:
    """Three significant digits; NULL stays, what isn't positive is 0."""
    x = col(x).cast("double")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.when(x > 0, x))) - 2)
    return F.when(x.isNull(), F.lit(None)).when(x <= 0, 0.0).otherwise(F.round(x / scale) * scale)


# geometry on the sphere and the plane


def separation_deg(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle separation that is stable at all distances."""
    d = F.radians(col(ra2)) - F.radians(col(ra1))
    p, q = F.radians(col(dec1)), F.radians(col(dec2))
    y = F.hypot(F.cos(q) * F.sin(d), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))
    return F.degrees(F.atan2(y, F.sin(p) * F.sin(q) + F.cos(p) * F.cos(q) * F.cos(d)))


def haversine_deg(ra1, dec1, ra2, dec2) -> Column:
    d, e = F.radians(col(ra2) - col(ra1)) / 2, F.radians(col(dec2) - col(dec1)) / 2
    h = F.pow(F.sin(e), 2) + F.cos(F.radians(col(dec1))) * F.cos(F.radians(col(dec2))) * F.pow(F.sin(d), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def tangent_project(ra, dec, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Gnomonic plane coordinates in degrees; NULL on the far side."""
    a, d, d0 = F.radians(col(ra) - ra0), F.radians(col(dec)), F.radians(F.lit(dec0))
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    near = F.when(c > 0, c)
    return F.degrees(F.cos(d) * F.sin(a) / near), F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / near)


def tangent_deproject(x, y, ra0: float, dec0: float) -> tuple[Column, Column]:
    x, y, d0 = F.radians(col(x)), F.radians(col(y)), F.radians(F.lit(dec0))
    down = F.cos(d0) - y * F.sin(d0)
    ra = ra0 + F.degrees(F.atan2(x, down))
    return F.pmod(ra, F.lit(360.0)), F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.hypot(x, down)))


def sexagesimal(text, hours: bool = False) -> Column:
    """'-00:30:00' and '12 30 00' to degrees; the sign is the text's, junk is NULL."""
    t = F.trim(col(text))
    parts = F.split(F.regexp_replace(t, r"^[+-]", ""), r"[\s:]+")
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.when(F.get(parts, F.lit(i)).isNull(), 0.0))
    whole = number(0) + number(1) / 60 + number(2) / 3600
    return F.when(F.size(parts) > 3, F.lit(None)).otherwise(F.when(t.startswith("-"), -whole).otherwise(whole) * (15 if hours else 1))


def airmass(altitude_deg) -> Column:
    """Kasten and Young's formula; NULL below the horizon."""
    h = col(altitude_deg)
    return F.when(h > 0, 1 / (F.sin(F.radians(h)) + 0.50572 * F.pow(h + 6.07995, -1.6364)))


# photometric units


def instrumental_mag(flux, exposure=1.0, zero: float = 25.0) -> Column:
    rate = col(flux) / (F.lit(exposure) if isinstance(exposure, float) else col(exposure))
    return F.when(rate > 0, zero - 2.5 * F.log10(rate))


def mag_error(flux, error) -> Column:
    return F.when(col(flux) > 0, MAG_PER_RELATIVE_FLUX * col(error) / col(flux))


def transmission(mag, typical) -> Column:
    return F.pow(F.lit(10.0), 0.4 * (col(typical) - col(mag)))


def fwhm_from_axes(a, b) -> Column:
    return 2.3548200450309493 * F.sqrt((col(a) * col(a) + col(b) * col(b)) / 2)


def clip(x, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def quadrature(*terms) -> Column:
    total = F.lit(0.0)
    for t in terms:
        total = total + col(t) * col(t)
    return F.sqrt(total)


def quadrature_excess(a, b) -> Column:
    d = col(a) * col(a) - col(b) * col(b)
    return F.when(d >= 0, F.sqrt(d))


def within_tolerance(a, b, floor: float, relative: float) -> Column:
    """|a - b| <= max(floor, relative |b|), both ends included."""
    return F.abs(col(a) - col(b)) <= F.greatest(F.lit(floor), relative * F.abs(col(b)))


# verdicts


def classify_state(mag, threshold, half_width) -> Column:
    """HIGH is brighter than the threshold by more than its half width, LOW fainter; without a half width the threshold itself divides."""
    as_col = lambda x: F.lit(x) if isinstance(x, int | float) else col(x)
    away, wide = col(mag) - as_col(threshold), F.coalesce(as_col(half_width), F.lit(0.0))
    return F.when(away.isNull(), "UNKNOWN").when(away < -wide, "HIGH").when(away > wide, "LOW").otherwise("INTERMEDIATE")


def agreement(a, b, sa, sb, bar: float = 3.0) -> Column:
    s = F.sqrt(col(sa) * col(sa) + col(sb) * col(sb))
    return F.when(s > 0, F.abs(col(a) - col(b)) / s <= bar)


def allowed_transition(before, after, terminal: list[str]) -> Column:
    """pending to a terminal state, or back to pending; nothing else."""
    return ((col(before) == "pending") & col(after).isin(terminal)) | (col(before).isin(terminal) & (col(after) == "pending"))


def gate_movement(before, after) -> Column:
    return F.when(col(before) & col(after), "unchanged_in").when(col(before), "moved_out").when(col(after), "moved_in").otherwise("unchanged_out")


def passes_list(x, allowed: list[str] | None = None, denied: list[str] | None = None) -> Column:
    """A blank fails a whitelist and passes a blacklist."""
    key = norm_filter(x)
    ok = F.lit(True)
    if allowed is not None:
        ok = ok & (key != "") & key.isin([a.lower() for a in allowed])
    if denied is not None:
        ok = ok & ~key.isin([d.lower() for d in denied])
    return ok


def hash_fraction(parts: list[Column]) -> Column:
    """A number in [0, 1) fixed by the values: the first 32 bits of their SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
