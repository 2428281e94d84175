"""Positions on the sky, sidereal time, field rotation, drift and the moon's phase, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the astronomy.
SIDEREAL_ARCSEC_PER_SEC, ZENITH_GUARD_DEG = 15.041067, 88.0
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def _wrap(x: Column, turn: float) -> Column:
    return x - turn * F.floor(x / turn)


def normalise_hours(h: Column) -> Column:
    return _wrap(h, 24.0)


def normalise_degrees(d: Column) -> Column:
    return _wrap(d, 360.0)


def declination_deg(alt: Column, az: Column, lat: Column) -> Column:
    a, z, p = F.radians(alt), F.radians(az), F.radians(lat)
    s = F.sin(a) * F.sin(p) + F.cos(a) * F.cos(p) * F.cos(z)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def hour_angle_deg(alt: Column, az: Column, lat: Column) -> Column:
    a, z, p = F.radians(alt), F.radians(az), F.radians(lat)
    return F.degrees(F.atan2(-F.sin(z) * F.cos(a), F.sin(a) * F.cos(p) - F.cos(a) * F.sin(p) * F.cos(z)))


def right_ascension_hours(alt: Column, az: Column, lat: Column, lst_hours: Column) -> Column:
    return normalise_hours(lst_hours - hour_angle_deg(alt, az, lat) / 15.0)


def field_rotation(alt: Column, az: Column, lat: Column) -> Column:
    """Arc seconds a second; the altitude is held away from the zenith, where it diverges."""
    held = F.greatest(F.lit(-ZENITH_GUARD_DEG), F.least(F.lit(ZENITH_GUARD_DEG), alt))
    return SIDEREAL_ARCSEC_PER_SEC * F.cos(F.radians(lat)) * F.cos(F.radians(az)) / F.cos(F.radians(held))


def near_zenith(alt: Column) -> Column:
    return F.abs(alt) > ZENITH_GUARD_DEG


def julian_date(epoch_ms: Column) -> Column:
    return epoch_ms / 86_400_000.0 + 2_440_587.5


def gmst_hours(epoch_ms: Column) -> Column:
    return normalise_hours(18.697374558 + 24.06570982441908 * (julian_date(epoch_ms) - 2_451_545.0))


def lst_hours(epoch_ms: Column, longitude: Column) -> Column:
    return normalise_hours(gmst_hours(epoch_ms) + longitude / 15.0)


def moon_elongation_deg(epoch_ms: Column) -> Column:
    return normalise_degrees(297.8501921 + 12.19074912 * (julian_date(epoch_ms) - 2_451_545.0))


def moon_fraction(epoch_ms: Column) -> Column:
    return (1.0 + F.cos(F.radians(180.0 - moon_elongation_deg(epoch_ms)))) / 2.0


def moon_waxing(epoch_ms: Column) -> Column:
    return moon_elongation_deg(epoch_ms) < 180.0


def compass_point(az: Column) -> Column:
    i = F.floor(normalise_degrees(az) / 22.5 + 0.5).cast("int") % 16
    return F.get(F.array(*[F.lit(p) for p in COMPASS]), i)


def format_declination(dec: Column) -> Column:
    minutes = F.floor(F.abs(dec) * 60.0 + 0.5).cast("long")
    return F.format_string("%s%02d° %02d′", F.when(dec < 0, F.lit("-")).otherwise(F.lit("+")), F.floor(minutes / 60), minutes % 60)


def drift_rates(alt: Column, az: Column, lat: Column) -> Column:
    """struct(altitude, azimuth) in arc seconds a second on the sky; azimuth is null near the zenith."""
    a, z, p = F.radians(alt), F.radians(az), F.radians(lat)
    turn = F.when(~near_zenith(alt), SIDEREAL_ARCSEC_PER_SEC * (F.sin(p) - F.cos(p) * F.cos(z) * F.tan(a)) * F.cos(a))
    return F.struct((SIDEREAL_ARCSEC_PER_SEC * F.cos(p) * F.sin(z)).alias("altitude"), turn.alias("azimuth"))


def drift_seed(alt: Column, az: Column, lat: Column, roll: Column, arcsec_per_pixel: Column, seconds: Column) -> Column:
    """struct(rotation_deg, dx, dy) expected after some seconds; null where the drift is not known."""
    r, t = drift_rates(alt, az, lat), F.radians(roll)
    along, up = r["azimuth"] * seconds / arcsec_per_pixel, r["altitude"] * seconds / arcsec_per_pixel
    seed = F.struct((field_rotation(alt, az, lat) * seconds / 3600.0).alias("rotation_deg"), (along * F.cos(t) - up * F.sin(t)).alias("dx"), (-(up * F.cos(t) + along * F.sin(t))).alias("dy"))
    return F.when((arcsec_per_pixel > 0) & ~near_zenith(alt), seed)


def implied_declination(alt: Column, az: Column, lat: Column) -> Column:
    """The declination, without its sign, of a field that drifts as fast as this pointing does; null where the drift is not known."""
    r = drift_rates(alt, az, lat)
    share = F.hypot(r["altitude"], r["azimuth"]) / SIDEREAL_ARCSEC_PER_SEC
    return F.when(r["azimuth"].isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), share))))


def same_field(alt_a: Column, az_a: Column, alt_b: Column, az_b: Column, tolerance: Column) -> Column:
    """Whether one seed serves both pointings: altitudes and azimuths, around the circle, within the tolerance."""
    turn = F.pmod(az_a - az_b, F.lit(360.0))
    return (F.abs(alt_a - alt_b) <= tolerance) & (F.least(turn, 360.0 - turn) <= tolerance)
