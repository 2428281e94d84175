"""Exposure: trailing limits, compensation, sensor noise, the exposure table, session plans and lunar exposures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightloom.functions import sky

#: Fixed values of the exposure rules.
ARCSEC_PER_RADIAN, TOLERANCE_PX = 206264.806, 1.5
MAX_STOPS, STOP_STEP, LONG_SUB_FACTOR = 4.0, 1.0 / 6.0, 2.6
SKY_LIMIT_FACTOR, MAX_BACKGROUND_FRACTION, LEAST_SKY_RATE, INVARIANCE_TOLERANCE = 4.0, 0.33, 1e-6, 0.10
DUAL_GAIN_DROP = 1.3
DARK_FRACTION, LEAST_DARKS, MOST_DARKS = 0.15, 10, 30
BYTES_A_FRAME, RESERVE_BYTES, BATTERY_AN_HOUR = 25_195_876, 500 * 1024 * 1024, 18.0
LOONEY_APERTURE, TARGET_PEAK, ACCEPT_LOW, ACCEPT_HIGH, MAX_LUNAR_STEP, CLIPPED_STEP = 11.0, 0.70, 0.60, 0.80, 64.0, 16.0


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def arcsec_per_pixel(pitch_um: Column, focal_mm: Column) -> Column:
    return ARCSEC_PER_RADIAN * pitch_um / (focal_mm * 1000.0)


def half_field_deg(width_mm: Column, height_mm: Column, focal_mm: Column) -> Column:
    return F.when(focal_mm > 0, F.degrees(F.atan(F.hypot(width_mm, height_mm) / 2.0 / focal_mm))).otherwise(F.lit(0.0))


def trailing_limit_seconds(scale: Column, half_field: Column, centre_dec: Column, tolerance_px: float = TOLERANCE_PX) -> Column:
    """The longest exposure whose fastest star trails no more than the tolerance; without a pointing, on the equator."""
    dec = F.coalesce(F.greatest(F.abs(centre_dec) - F.abs(half_field), F.lit(0.0)), F.lit(0.0))
    return tolerance_px * scale / (sky.SIDEREAL_ARCSEC_PER_SEC * F.cos(F.radians(dec)))


def snap_stops(stops: Column) -> Column:
    return half_up(clamp(stops, -MAX_STOPS, MAX_STOPS) / STOP_STEP) * STOP_STEP


def frame_cost_seconds(sub: Column, longest: Column, overhead: Column) -> Column:
    long = F.coalesce((longest > 0) & (sub > longest), F.lit(False))
    return F.when(long, sub * LONG_SUB_FACTOR).otherwise(sub + overhead)


def candidate(rate: Column, iso: Column, full_scale: Column, read_noise: Column, ceiling: Column, dual_gain_iso: Column | None = None) -> Column:
    """struct of one ISO's exposure: required and allowed seconds, ratio of variances, background, headroom, verdict."""
    r = F.greatest(rate, F.lit(LEAST_SKY_RATE))
    variance = read_noise * read_noise
    clip = MAX_BACKGROUND_FRACTION * full_scale / r
    seconds = F.least(ceiling, clip)
    electrons = rate * seconds
    below = iso < dual_gain_iso if dual_gain_iso is not None else F.lit(False)
    verdict = F.when(F.coalesce(below, F.lit(False)), F.lit("BELOW_DUAL_GAIN")).when(electrons >= SKY_LIMIT_FACTOR * variance, F.lit("SKY_LIMITED")).otherwise(F.lit("READ_NOISE_LIMITED"))
    return F.struct(
        (SKY_LIMIT_FACTOR * variance / r).alias("required_seconds"), seconds.alias("exposure_seconds"), electrons.alias("sky_electrons"), (electrons / variance).alias("sky_to_read"),
        (electrons / full_scale).alias("background"), F.log2(full_scale / electrons).alias("headroom_stops"), (clip < ceiling).alias("clipping_limited"), verdict.alias("verdict"),
    )


def dark_count(lights: Column) -> Column:
    return F.greatest(F.lit(LEAST_DARKS), F.least(F.lit(MOST_DARKS), half_up(lights * DARK_FRACTION)))


def lights_that_fit(seconds: Column, per_frame: Column) -> Column:
    """The most lights that fit with their darks. Darks are 10 to 30, so only that many answers are possible."""
    most = F.floor(seconds / per_frame)
    fit = F.filter(F.sequence(most - MOST_DARKS, most - LEAST_DARKS), lambda n: (n + dark_count(n)) * per_frame <= seconds)
    return F.greatest(F.coalesce(F.array_max(fit), F.lit(1)), F.lit(1))


def common_area_fraction(rotation_deg: Column, width: float, height: float) -> Column:
    """The share of a frame that stays in view when it turns."""
    t = F.radians(F.abs(rotation_deg))
    s = F.least(height / (width * F.sin(t) + height * F.cos(t)), width / (width * F.cos(t) + height * F.sin(t)))
    return F.when(t <= 0, F.lit(1.0)).when(F.abs(rotation_deg) >= 90, F.lit(0.0)).otherwise(clamp(s * s, 0.0, 1.0))


def severity(needed: Column, available: Column) -> Column:
    return F.when(needed > available, F.lit("BLOCK")).when(needed > available * 0.8, F.lit("WARN")).otherwise(F.lit("OK"))


def looney_eleven_ns(aperture: Column, iso: Column) -> Column:
    ratio = aperture / LOONEY_APERTURE
    return F.greatest(half_up(ratio * ratio / iso * 1e9), F.lit(1)).cast("long")


def lunar_probe(exposure_ns: Column, peak_fraction: Column, clipped: Column) -> Column:
    """struct(verdict, next_ns): what a test exposure says and what to try next (null when it is settled)."""
    f = clamp(peak_fraction, 0.0, 1.0)
    scale = F.when(clipped > 0, F.lit(1.0 / CLIPPED_STEP)).when(f <= 0, F.lit(MAX_LUNAR_STEP)).otherwise(clamp(TARGET_PEAK / f, 1.0 / MAX_LUNAR_STEP, MAX_LUNAR_STEP))
    settled = (clipped <= 0) & (f >= ACCEPT_LOW) & (f <= ACCEPT_HIGH)
    verdict = F.when(clipped > 0, F.lit("CLIPPED")).when(settled, F.lit("SETTLED")).when(f < ACCEPT_LOW, F.lit("DIM")).otherwise(F.lit("BRIGHT"))
    return F.struct(verdict.alias("verdict"), F.when(~settled, F.greatest(half_up(exposure_ns * scale), F.lit(1)).cast("long")).alias("next_ns"))


def parabola_vertex(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """x of the extremum of the parabola through three points; null where they lie on a line."""
    den = (x0 - x1) * (x0 - x2) * (x1 - x2)
    a = (x2 * (y1 - y0) + x1 * (y0 - y2) + x0 * (y2 - y1)) / den
    b = (x2 * x2 * (y0 - y1) + x1 * x1 * (y2 - y0) + x0 * x0 * (y1 - y2)) / den
    return F.when(F.abs(a) > 1e-12, -b / (2 * a))
