"""Verdict ladders as column expressions. NULL stands for what was not measured, and NaN counts as NULL: Spark would rank it above all numbers.
Where a rung asks whether a value was measured at all, an infinity counts as NULL too.

Thresholds and labels are fixed values of the survey's rules; each can be overridden where it is a parameter.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesforge.functions.scalars import basename_of, col, finite, safe_div, strip_compression


def case(*rungs: tuple[Column, object], other=None) -> Column:
    """The value of the first condition that holds; a NULL condition does not hold."""
    out = F.lit(other) if not isinstance(other, Column) else other
    for when, value in reversed(rungs):
        out = F.when(when, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def real(x) -> Column:
    """The number, with NaN as NULL."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


# files and frames


def calib_kind(imagetyp, name) -> Column:
    """bias, dark or flat: by the header, by the name of a master (a dark for flats is a dark), by the name of a flat series."""
    kind, low = F.trim(F.coalesce(col(imagetyp), F.lit(""))), F.lower(basename_of(name))
    master = case((low.contains("bias"), "bias"), (low.contains("dark"), "dark"), (low.contains("flat"), "flat"))
    return case(
        (kind == "Bias Frame", "bias"), (kind == "Dark Frame", "dark"), (kind.isin("Flat Field", "FLAT"), "flat"), (low.startswith("master"), master),
        (low.rlike(r"^[a-z]{1,3}\.flat\d") | low.contains("flat-light"), "flat"),
    )


def is_science(imagetyp, kind) -> Column:
    label = F.lower(F.trim(F.coalesce(col(imagetyp), F.lit(""))))
    return col(kind).isNull() & ((label == "") | label.startswith("light"))


def calib_role(kind, is_master) -> Column:
    return F.when(col(is_master), F.concat(F.lit("master_"), col(kind))).otherwise(col(kind))


def coverage_cell(n_raw, n_master, wanted) -> Column:
    return case((col(n_raw) >= col(wanted), "ok"), (col(n_raw) > 0, "partial"), (col(n_master) > 0, "master_only"), other="missing")


def gap_spec(kind, key, n_raw, wanted) -> Column:
    """'dark 240s x >=15 (have 0)'."""
    named = F.concat(col(kind), F.when(F.coalesce(col(key), F.lit("")) != "", F.concat(F.lit(" "), col(key))).otherwise(""))
    return F.concat(named, F.lit(" x >="), col(wanted).cast("string"), F.lit(" (have "), col(n_raw).cast("string"), F.lit(")"))


def compact_seconds(x) -> Column:
    """'240s', '0.1s', '?s': six significant digits without trailing zeros, with an exponent below 0.0001 and from 1000000 on."""
    v = finite(x)
    short = F.format_string("%.5e", v)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.split_part(short, F.lit("e"), F.lit(2)).cast("int")
    text = F.when(power.between(-4, 5), bare(short.cast("decimal(38,12)").cast("string"))).otherwise(F.concat(bare(F.split_part(short, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(short, F.lit("e"), F.lit(2))))
    return F.when(v.isNull(), "?s").otherwise(F.concat(text, F.lit("s")))


def exposure_token(name) -> Column:
    """Seconds in a file name: '_0p0001s_' is 0.0001."""
    return F.replace(F.nullif(F.regexp_extract(col(name), r"_(\d+(?:p\d+)?)s(?=[_.]|$)", 1), F.lit("")), F.lit("p"), F.lit(".")).try_cast("double")


def effective_exposure(header, name) -> Column:
    """The name's token where the header is missing, not positive, or off by more than a fifth of the larger."""
    h, token = real(header), exposure_token(name)
    off = F.abs(h - token) > 0.2 * F.greatest(h, token)
    return case((h.isNull() | (h <= 0), F.coalesce(token, h)), ((token > 0) & off, token), other=h)


def table_slug(project) -> Column:
    return F.regexp_replace(F.lower(col(project)), "[^a-z0-9]+", "_")


def archive_path(root: str, relative) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(col(relative), "^/+", ""))


def sidecar_path(relative, suffix: str = ".wcs") -> Column:
    return F.concat(F.regexp_replace(strip_compression(relative), r"(?i)\.(fits|fit|fts)$", ""), F.lit(suffix))


def mode_label(mode) -> Column:
    return F.coalesce(F.nullif(F.trim(col(mode)), F.lit("")), F.lit("(blank)"))


def run_night(utc_nights, nights) -> Column:
    return F.split_part(F.coalesce(F.nullif(col(utc_nights), F.lit("")), col(nights), F.lit("")), F.lit("+"), F.lit(1))


def nights_of(utc_nights, nights) -> Column:
    return F.filter(F.split(F.coalesce(F.nullif(col(utc_nights), F.lit("")), col(nights), F.lit("")), r"\+"), lambda x: x != "")


def run_scope(utc_nights, nights) -> Column:
    """First night, and the last one if there are several: its day alone in the same month."""
    parts = nights_of(utc_nights, nights)
    first, last = F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(-1))
    return case((F.size(parts) == 0, ""), (F.size(parts) == 1, first), ((F.substring(first, 1, 7) == F.substring(last, 1, 7)) & (F.length(last) >= 10), F.concat(first, F.lit("+"), F.substring(last, 9, 2))), other=F.concat(first, F.lit("+"), last))


def is_multi_night(utc_nights, nights) -> Column:
    return F.size(nights_of(utc_nights, nights)) > 1


def is_stackpro(mode) -> Column:
    return F.lower(F.coalesce(col(mode), F.lit(""))).contains("stackpro")


def mid_method(mode, jd, exposure_s) -> Column:
    return case((finite(jd).isNull(), "no_jd"), (finite(exposure_s).isNull() | (col(exposure_s) <= 0), "exptime_nonpos_start_used"), (is_stackpro(mode), "stackpro_sum_midpoint_half_exptime"), other="start_plus_half_exptime")


def mid_jd(jd, exposure_s) -> Column:
    return col(jd) + F.when(finite(exposure_s) > 0, col(exposure_s) / 2 / 86400).otherwise(0.0)


def worst_mid_error_s(mode) -> Column:
    return F.when(is_stackpro(mode), 11.35 / 2).otherwise(0.0)


def qc_flags(error, exposure, airmass, jd, ra, target, offset_deg) -> Column:
    named = {
        "header_error": F.trim(col(error)) != "", "exptime_nonpos": real(exposure) <= 0, "airmass_garbage": (real(airmass) < 1) | (real(airmass) > 10), "no_jd": real(jd).isNull(),
        "no_coords": real(ra).isNull(), "blank_target": col(target).isNull(), "pointing_gt1deg": real(offset_deg) > 1,
    }
    return F.concat_ws(",", *[F.when(p, F.lit(n)) for n, p in named.items()])


# geometry, registration, saturation


def is_implausible(naxis1, naxis2, least: float = 64) -> Column:
    return F.coalesce((col(naxis1) < least) | (col(naxis2) < least), F.lit(True)) | col(naxis1).isNull() | col(naxis2).isNull()


def is_window(naxis1, naxis2, least: float) -> Column:
    """Whether the short axis is under `least`; unknown sizes count as windows."""
    return F.coalesce(F.when(col(naxis1).isNotNull() & col(naxis2).isNotNull(), F.least(col(naxis1), col(naxis2)) < least), F.lit(True))


def geometry_verdict(naxis1, naxis2, aperture_px, radii: float = 6.0) -> Column:
    """'ok', or why an aperture and its sky do not fit into the frame."""
    return case(
        (col(naxis1).isNull() | col(naxis2).isNull(), "dimensions unknown"), (finite(aperture_px).isNull() | (col(aperture_px) <= 0), "no aperture"),
        (F.least(col(naxis1), col(naxis2)) < radii * col(aperture_px), "does not fit"), other="ok",
    )


def registration_method(frame_has_wcs, reference_has_wcs) -> Column:
    return F.when(col(frame_has_wcs) & col(reference_has_wcs), "wcs").otherwise("stars")


def match_rate(n_match, n_det, n_ref) -> Column:
    return safe_div(col(n_match), F.least(col(n_det), col(n_ref)))


def wcs_match_ok(n_match, n_det, n_ref, fraction: float = 0.30, least: int = 8) -> Column:
    return (col(n_match) >= least) & F.coalesce(match_rate(n_match, n_det, n_ref) >= fraction, F.lit(False))


def chance_matches(n_det, n_ref, tol_px, area_px2) -> Column:
    return safe_div(col(n_det) * col(n_ref) * F.pi() * col(tol_px) * col(tol_px), col(area_px2))


def beats_chance(n_match, chance, factor: float = 10.0, least: int = 8) -> Column:
    return (col(n_match) >= least) & (col(n_match) >= factor * F.greatest(col(chance), F.lit(0.1)))


def is_saturated(peak, background, veto) -> Column:
    """Without a measured veto nothing is called saturated."""
    return F.coalesce(real(peak) + real(background) >= real(veto), F.lit(False))


def applied_veto(veto, dark_median) -> Column:
    return real(veto) - F.coalesce(real(dark_median), F.lit(0.0))


def reduced_veto(veto, flat, dark, pedestal) -> Column:
    return F.when(real(flat) > 0, (real(veto) - real(dark)) / col(flat) + real(pedestal))


def veto_level(clip, fraction: float = 0.92, step: int = 100) -> Column:
    return (F.floor(fraction * col(clip) / step) * step).cast("long")


def bits_of(clip) -> Column:
    return F.ceil(F.log2(col(clip) + 1)).cast("int")


def screen(clip, fraction: float) -> Column:
    """A level at a fraction of the measured clip; without one there is no screen, which is an error and not a default."""
    return F.when(col(clip).isNull(), F.raise_error(F.lit("no measured clip"))).otherwise(F.bround(fraction * col(clip)).cast("long"))


def position_quality(offset_px, has_wcs, most: float = 6.0) -> Column:
    return case((~F.coalesce(col(has_wcs), F.lit(False)), "bound"), (real(offset_px) <= most, "wcs"), other="wcs_off")


def saturation_class(peak, quality, suspect, reject) -> Column:
    """Where the position is not known the peak is an upper bound: only 'under the screen' can be concluded."""
    high = real(peak)
    known = case((high >= col(reject), "rejected"), (high >= col(suspect), "suspect"), other="clean")
    return case((high.isNull(), "undetermined"), (col(quality) == "wcs", known), (high < col(suspect), "bounded_clean"), other="undetermined")


def band_role(band, broad: list[str], narrow: list[str]) -> Column:
    b = F.trim(F.coalesce(col(band), F.lit("")))
    return case((b.isin(broad), "broadband"), (b.isin(narrow), "narrowband"), other="other")


def epoch_role(night, first: str, last: str) -> Column:
    return case((col(night) < first, "template_pre"), (col(night) <= last, "campaign"), other="template_post")


def dispersion_class(verdict) -> Column:
    return F.coalesce(F.nullif(F.trim(col(verdict)), F.lit("")), F.lit("unmeasured"))


def is_direct_image(verdict) -> Column:
    """Excluding a frame needs a measurement; a frame without one is included."""
    return dispersion_class(verdict) != "dispersed"


def strength(trace_px, width, least: float = 0.15) -> Column:
    share = finite(safe_div(real(trace_px), real(width)))
    return case((share.isNull(), "n/a"), (share >= least, "high"), other="ambiguous")


def solution_sane(scale, n_matched, rms, low, high, least: int, most_rms: float) -> Column:
    return F.coalesce(real(scale).between(real(low), real(high)) & (col(n_matched) >= least) & (real(rms) <= most_rms), F.lit(False))


def diagnose(n_sources, n_stars, elongation, saturated, bright_px) -> Column:
    """The first cause that the image's statistics show; what is left is unexplained."""
    return case(
        (col(n_sources).isNull(), "unreadable"), (real(bright_px) > 6.0, "defocused"), (col(n_stars).isNull() | (col(n_stars) < 15) | (real(bright_px) < 0.9), "starved"),
        (real(elongation) > 1.8, "trailing"), (real(saturated) > 0.02, "saturated"), other="unexplained",
    )


def qc_pregate(diagnosis) -> Column:
    return col(diagnosis).startswith("unexplained")


# series, nights, calibration


def series_admission(n_frames, least: int = 12) -> Column:
    return case((col(n_frames) <= 0, "none"), (col(n_frames) < least, "too few"), other="admitted")


def target_verdict(n_rows, n_measured, least: int = 12) -> Column:
    return case(((col(n_rows) <= 0) | (col(n_measured) <= 0), "undetected"), (col(n_measured) >= least, "measured"), other="sparse")


def check_verdict(n_check, least: int = 3) -> Column:
    return case((col(n_check) >= least, "validated"), (col(n_check) > 0, "weak"), other="unvalidated")


def night_state(mag, baseline, quiet: float = 0.6, burst: float = 1.0) -> Column:
    rise = finite(baseline) - finite(mag)
    return case((rise.isNull(), "UNKNOWN"), (rise >= burst, "OUTBURST"), (rise <= quiet, "QUIESCENT"), other="ELEVATED")


def colour_position(colour, low, high, p05, p95) -> Column:
    return case((finite(colour).isNull() | finite(low).isNull(), "unknown"), (col(colour).between(real(p05), real(p95)), "inside-core"), (col(colour).between(real(low), real(high)), "inside-span"), other="extrapolated")


def colour_reach_error(colour, low, high, slope, slope_error) -> Column:
    reach = F.greatest(finite(colour) - real(high), real(low) - finite(colour), F.lit(0.0))
    return F.when(finite(colour).isNotNull() & finite(low).isNotNull(), (F.abs(real(slope)) + F.abs(real(slope_error))) * reach)


def block_verdict(n_tie, n_check, check_rms, converged) -> Column:
    return case(
        ((col(n_tie) < 8) | ~col(converged), "UNTIED"), ((col(n_check) < 4) | finite(check_rms).isNull(), "TIED-UNVERIFIED"),
        (col(check_rms) <= 0.01, "TIED-STRETCH"), (col(check_rms) <= 0.02, "TIED-GOAL"), other="TIED-ABOVE-GOAL",
    )


def goal_verdict(n_tied, n_met, n_series) -> Column:
    return case(((col(n_tied) == col(n_series)) & (col(n_met) == col(n_series)), "SUPPORTED"), (col(n_tied) == col(n_series), "SUPPORTED-WITH-CAVEATS"), (col(n_tied) == 0, "NOT SUPPORTED"), other="PARTIALLY SUPPORTED")


def range_check(mag, low, high, tolerance: float) -> Column:
    m, a, b = finite(mag), finite(low), finite(high)
    gap = F.greatest(a - m, m - b)
    return case((m.isNull() | a.isNull() | b.isNull(), "unknown"), (gap <= 0, "inside"), (gap <= tolerance, "near"), other="outside")


def bright_limit_risk(mag, limit) -> Column:
    return F.coalesce(real(mag) <= real(limit), F.lit(False))


def transmission_label(transmission, clear_mag: float, attenuated_mag: float) -> Column:
    t = finite(transmission)
    loss = F.when(t > 0, -2.5 * F.log10(F.when(t > 0, t)))
    return case((loss >= attenuated_mag, "attenuated"), (F.abs(loss) <= clear_mag, "clear"), other="")


# decisions


def detection_call(amplitude, contour, power, threshold, cycles, least_cycles: float = 1.5) -> Column:
    """Two independent tests behind a coverage gate."""
    by_amplitude, by_power = (finite(amplitude) >= finite(contour)), (finite(power) > finite(threshold))
    return case(
        (finite(cycles) < least_cycles, "AMPLITUDE ONLY"), (by_amplitude.isNull() | by_power.isNull(), "UNTESTED"),
        (by_amplitude & by_power, "DETECTED"), (by_amplitude | by_power, "MARGINAL"), other="NOT DETECTED",
    )


def capability(measured, bar, higher: bool = True) -> Column:
    m, b = finite(measured), finite(bar)
    ok = (m >= b) if higher else (m <= b)
    return case((ok.isNull(), "UNTESTED"), (ok, "SUPPORTED"), other="NOT SUPPORTED")


def nights_needed(have, bar, per_season) -> dict[str, Column]:
    short = F.greatest(col(bar) - col(have), F.lit(0))
    return {"shortfall": short, "seasons": F.when(col(per_season) > 0, short / col(per_season))}


def snr_gate(sigma, amplitude, wanted: float = 5.0) -> dict[str, Column]:
    s, a = finite(sigma), finite(amplitude)
    ratio = F.when(s > 0, a / F.when(s > 0, s))
    return {"ratio": ratio, "passes": F.coalesce(ratio >= wanted, F.lit(False)), "margin": F.when(ratio.isNotNull(), a - wanted * s)}


def agreement_test(value, sigma, published, published_sigma, bar: float = 3.0) -> dict[str, Column]:
    """Deviation in sigmas and whether it is within the bar; a missing sigma counts as none, two missing ones allow no test."""
    s = F.hypot(F.coalesce(finite(sigma), F.lit(0.0)), F.coalesce(finite(published_sigma), F.lit(0.0)))
    deviation = F.when(s > 0, (finite(value) - finite(published)) / F.when(s > 0, s))
    return {"deviation": deviation, "agrees": F.coalesce(F.abs(deviation) <= bar, F.lit(False))}


def family_choice(n_blocks, alias_share, has_prior, decidable: float = 0.20) -> Column:
    return case((finite(alias_share).isNull(), "UNRESOLVED"), (col(alias_share) < decidable, "DATA"), (col(n_blocks) <= 1, "SINGLE-NIGHT"), (~col(has_prior), "UNRESOLVED"), other="PRIOR")


def peak_class(peak, true, alias: float = 1.0, tolerance: float = 0.02, orders: int = 3) -> Column:
    """true, alias (of an order up to `orders`, negative frequencies folded) or other."""
    tol = tolerance * col(true)
    near = F.lit(False)
    for k in (*range(-orders, 0), *range(1, orders + 1)):
        f = F.abs(col(true) + k * alias)
        near = near | ((f > 1e-9) & (F.abs(col(peak) - f) <= tol))
    return case((F.abs(col(peak) - col(true)) <= tol, "true"), (near, "alias"), other="other")


def contour_reached(share, wanted: float = 0.9) -> Column:
    return case((finite(share).isNull(), "UNTESTED"), (col(share) >= wanted, "RECOVERED"), other="LOST")
