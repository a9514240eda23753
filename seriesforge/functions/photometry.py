"""Photometric, timing and template arithmetic as column expressions; what can't be computed is NULL."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesforge.functions.scalars import MAG_PER_RELATIVE_FLUX, SECONDS_PER_DAY, col, safe_div

#: Seconds of light over one astronomical unit, arcseconds in a radian times a micrometre over a millimetre.
LIGHT_S_PER_AU, SCALE_UM_MM = 499.00478, 206.265


def plate_scale(pixel_um, focal_mm) -> Column:
    return F.when((col(pixel_um) > 0) & (col(focal_mm) > 0), SCALE_UM_MM * safe_div(col(pixel_um), col(focal_mm)))


def plate_scale_cd(cd11, cd12, cd21, cd22) -> Column:
    d = F.abs(col(cd11) * col(cd22) - col(cd12) * col(cd21))
    return F.when(d > 0, F.sqrt(d) * 3600)


def first_in_range(candidates: dict[str, Column], low: float, high: float) -> tuple[Column, Column]:
    """Value and name of the first candidate between low and high."""
    value, name = F.lit(None).cast("double"), F.lit("none")
    for n, c in reversed(list(candidates.items())):
        value, name = F.when(c.between(low, high), c).otherwise(value), F.when(c.between(low, high), F.lit(n)).otherwise(name)
    return value, name


def aperture_radius(scale, arcsec: float = 4.0, low: float = 2.0, high: float = 30.0) -> Column:
    return F.when(col(scale) > 0, F.least(F.greatest(arcsec / F.when(col(scale) > 0, col(scale)), F.lit(low)), F.lit(high)))


def match_tolerance(fwhm_px, factor: float = 0.8, least: float = 2.0) -> Column:
    return F.greatest(factor * col(fwhm_px), F.lit(least))


def light_time_corner_s(naxis1, naxis2, scale) -> Column:
    return F.hypot(col(naxis1).cast("double"), col(naxis2).cast("double")) / 2 * F.radians(col(scale) / 3600) * LIGHT_S_PER_AU


def ellipticity(a, b) -> Column:
    return 1 - safe_div(col(b), col(a))


def illuminated_fraction(elongation_deg) -> Column:
    return (1 - F.cos(F.radians(col(elongation_deg)))) / 2


def predicted_sigma(flux, n_pix, background_rms, gain, n_sky=None) -> Column:
    """The CCD equation with a measured background; the sky has five apertures unless given."""
    sky = 5.0 * col(n_pix) if n_sky is None else col(n_sky)
    var = col(flux) / col(gain) + col(n_pix) * col(background_rms) ** 2 + col(n_pix) ** 2 / sky * col(background_rms) ** 2
    return F.when(col(flux) > 0, MAG_PER_RELATIVE_FLUX * F.sqrt(var) / F.when(col(flux) > 0, col(flux)))


def scintillation(airmass, exposure_s, diameter_cm: float, altitude_m: float) -> Column:
    """Young's formula with a scale height of 8000 m."""
    fixed = 0.09 * diameter_cm ** (-2 / 3) * math.exp(-altitude_m / 8000.0)
    return F.when((col(airmass) >= 1) & (col(exposure_s) > 0), fixed * F.pow(col(airmass), F.lit(1.75)) / F.sqrt(2 * F.when(col(exposure_s) > 0, col(exposure_s))))


def limit_flux(error, k: float = 3.0) -> Column:
    return F.when(col(error) > 0, k * col(error))


def limit_magnitude(flux, exposure_s, zero, offset: float = 25.0) -> Column:
    ok = (col(flux) > 0) & (col(exposure_s) > 0)
    return F.when(ok, -2.5 * F.log10(F.when(ok, col(flux) / col(exposure_s))) + offset - col(zero))


def least_amplitude(sigma, n, z: float = 18.0) -> Column:
    return col(sigma) * F.sqrt(safe_div(F.lit(4.0 * z), col(n)))


def colour_sigma(sigma_a, sigma_b, rate_per_s, dt_s) -> Column:
    return F.sqrt(col(sigma_a) ** 2 + col(sigma_b) ** 2 + (col(rate_per_s) * col(dt_s)) ** 2)


def duty_sigma(n, p: float = 0.5) -> Column:
    return F.sqrt(safe_div(F.lit(p * (1 - p)), col(n)))


def amplitude_sigma(a, b, var_a, var_b, cov) -> Column:
    r2 = col(a) ** 2 + col(b) ** 2
    return F.sqrt(safe_div(col(a) ** 2 * col(var_a) + col(b) ** 2 * col(var_b) + 2 * col(a) * col(b) * col(cov), r2))


def phase_difference(a, b) -> Column:
    """Wrapped to [-0.5, 0.5)."""
    x = col(a) - col(b) + 0.5
    return x - F.floor(x) - 0.5


def phase_drift(elapsed, period, sigma) -> Column:
    return safe_div(col(elapsed), col(period)) * safe_div(col(sigma), col(period))


def cycle_ambiguity(t, epoch, period, sigma) -> dict[str, Column]:
    n = safe_div(col(t) - col(epoch), col(period))
    drift = F.abs(n) * safe_div(col(sigma), col(period))
    return {"n_cycles": n, "drift": drift, "unique": drift < 0.5, "sigma_max": safe_div(0.5 * col(period), F.abs(n))}


def least_squares_period_sigma(n, baseline, amplitude, rms, period) -> Column:
    ok = (col(n) >= 4) & (col(baseline) > 0) & (col(amplitude) > 0) & (col(rms) > 0)
    return F.when(ok, F.sqrt(safe_div(F.lit(6.0), col(n))) * safe_div(col(rms), math.pi * col(baseline) * col(amplitude)) * col(period) ** 2)


def printed_sigma(text) -> Column:
    """Half a unit of the last digit that was printed; NULL without a decimal point."""
    mantissa = F.split_part(F.lower(F.trim(col(text))), F.lit("e"), F.lit(1))
    return F.when(F.contains(mantissa, F.lit(".")), 0.5 * F.pow(F.lit(10.0), -F.length(F.split_part(mantissa, F.lit("."), F.lit(2)))))


def excess_significance(total, total_sigma, floor, floor_sigma) -> Column:
    spread = F.sqrt((2 * col(total) * col(total_sigma)) ** 2 + (2 * col(floor) * col(floor_sigma)) ** 2)
    return safe_div(col(total) ** 2 - col(floor) ** 2, spread)


def structure_sigma(sf, n_pairs, n_points) -> Column:
    return safe_div(col(sf), F.sqrt(2.0 * F.least(col(n_pairs), col(n_points))))


def log_edges(low: float, high: float, n: int) -> Column:
    """n + 1 edges in equal ratios."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: low * F.pow(F.lit(high / low), i / n))


def alias_family(f, spacing: float = 1.0, orders: int = 3) -> Column:
    """(order, frequency) of the aliases up to an order; negative frequencies are folded."""
    return F.array(*[F.struct(F.lit(k).alias("order"), F.abs(col(f) + k * spacing).alias("f")) for k in range(-orders, orders + 1) if k])


def sinusoid(t, period: float, amplitude: float, phase: float = 0.0) -> Column:
    return amplitude * F.sin(2 * math.pi * (col(t) / period + phase))


def ramp(t, edge, width) -> Column:
    return F.least(F.greatest((col(t) - edge) / max(width, 1e-12) + 0.5, F.lit(0.0)), F.lit(1.0))


def eclipse(t, period: float, depth: float, width: float = 0.1, t0: float = 0.0, ingress: float = 0.02) -> Column:
    """A trapezoid dip around phase zero, positive where fainter."""
    x = (col(t) - t0) / period + 0.5
    away, outer = F.abs(x - F.floor(x) - 0.5), width / 2 + ingress / 2
    return depth * F.least(F.greatest((outer - away) / ingress, F.lit(0.0)), F.lit(1.0))


def bright_phase(t, period: float, t0: float, depth: float, width: float, edge: float) -> Column:
    """A plateau with ramps on both sides, negative where brighter."""
    x = (col(t) - t0 + period / 2) / period
    dt, half = (x - F.floor(x)) * period - period / 2, width * period / 2
    clip = lambda y: F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))
    return -depth * clip((dt + half) / edge + 0.5) * clip((half - dt) / edge + 0.5)


def colour_solve(native, k_blue, k_red, reference) -> Column:
    d = 1 + col(k_blue) - col(k_red)
    return F.when(F.abs(d) >= 1e-6, (col(native) + (col(k_blue) - col(k_red)) * col(reference)) / F.when(F.abs(d) >= 1e-6, d))


def shifted_position(ra, dec, dra_arcsec: float, ddec_arcsec: float) -> tuple[Column, Column]:
    return F.pmod(col(ra) + dra_arcsec / 3600 / F.cos(F.radians(col(dec))), F.lit(360.0)), col(dec) + ddec_arcsec / 3600


def axis_offset(angle_deg, axis_deg: float) -> Column:
    """Distance of two axes, at most 90 degrees."""
    d = F.pmod(col(angle_deg) - axis_deg, F.lit(180.0))
    return F.least(d, 180 - d)


def percent(k, n) -> Column:
    return 100 * safe_div(col(k), col(n))


def projected_hours(n, median_s, workers: int) -> Column:
    return col(n) * col(median_s) / workers / 3600


def days_between(a, b) -> Column:
    return F.datediff(col(a).cast("date"), col(b).cast("date"))


def next_date(night, days: int = 1) -> Column:
    return F.date_add(col(night).cast("date"), days)


def jd_of_text(text) -> Column:
    """JD of an ISO date and time with up to six digits of a second; junk is NULL."""
    ok = F.trim(col(text)).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$")
    stamp = F.when(ok, F.replace(F.trim(col(text)), F.lit("T"), F.lit(" "))).try_cast("timestamp_ntz")
    day = F.unix_date(stamp.cast("date"))
    return day + 2440587.5 + (F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.date_part(F.lit("SECOND"), stamp).cast("double")) / SECONDS_PER_DAY
