"""Scalar expressions. All are built-in functions, so they stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_of_day(ts) -> Column:
    """Hour 0-23 of a timestamp or timestamp text; null when it cannot be read.

    The zone-free type keeps the hour as written, whatever the session time zone.
    """
    return F.hour(_col(ts).try_cast("timestamp_ntz"))


def comma_to_dash(c) -> Column:
    return F.replace(_col(c), F.lit(","), F.lit(" -"))


def birth_year(dob) -> Column:
    """Year of a date or `yyyy-MM-dd` text; null when it cannot be read."""
    return F.year(F.try_to_date(_col(dob), "yyyy-MM-dd"))


def decade_flag(year, start: int) -> Column:
    return F.when(_col(year).between(start, start + 9), 1).otherwise(0)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km between two points in degrees."""
    phi1, phi2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    lam1, lam2 = F.radians(_col(lon1)), F.radians(_col(lon2))
    half_phi, half_lam = F.sin((phi2 - phi1) / 2), F.sin((lam2 - lam1) / 2)
    a = half_phi * half_phi + F.cos(phi1) * F.cos(phi2) * half_lam * half_lam
    # For antipodes `a` can exceed 1 by rounding; abs keeps the root real.
    return 2 * F.atan2(F.sqrt(a), F.sqrt(F.abs(1 - a))) * EARTH_RADIUS_KM


def above_threshold(score, threshold) -> Column:
    """1 when the score is strictly above the threshold, else 0."""
    return (_col(score) > threshold).cast("int")


def percent_change(new, old) -> Column:
    """Change from `old` to `new` in percent; null when `old` is 0 or null."""
    return F.try_divide(_col(new) - _col(old), _col(old)) * 100


def amount_ratio(amount, average) -> Column:
    """Amount over the card's average, 1 when there is no positive average."""
    return F.when(_col(average) > 0, _col(amount) / _col(average)).otherwise(F.lit(1.0))


def fixed_text(number, places: int) -> Column:
    """A number with this many decimals.

    Rounds the exact binary value, ties to even, as C and Python do; `format_string` rounds the
    shortest decimal text half up, and so 54.65 to 54.7.
    """
    pattern = F.lit("0." + "0" * places)
    return F.call_function("format_number", _col(number).cast("double"), pattern)


def anomaly_text(ratio) -> Column:
    return F.when(_col(ratio) > 1, F.concat(fixed_text(ratio, 1), F.lit("x"))).otherwise("normal")


def hour_gap_bucket(hour, usual) -> Column:
    """Plain difference of hours, not around the clock: 23 and 1 are 22 apart."""
    gap = F.abs(_col(hour) - _col(usual))
    return F.when(gap > 6, "significant").when(gap > 3, "moderate").otherwise("minor")


def clock_text(hour) -> Column:
    """Hour as clock text; a fraction of an hour is cut off."""
    h = _col(hour).cast("double")
    morning = F.concat(h.cast("int").cast("string"), F.lit(":00 AM"))
    return (
        F.when((h >= 0) & (h < 6), F.concat(morning, F.lit(" (early morning)")))
        .when((h >= 6) & (h < 12), morning)
        .when((h > 12) & ~F.isnan(h), F.concat((h - 12).cast("int").cast("string"), F.lit(":00 PM")))
        .otherwise("12:00 PM")
    )


def decade_text(first_year: int) -> str:
    return f"born in the {first_year}s"


# Fixed value: headings that generated text may start with.
RESPONSE_HEADING = r"(?i)^(Explanation|Analysis|Flagged as fraud):?\s*"


def clean_response(text) -> Column:
    """Generated text without outer blanks and without a leading heading."""
    return F.regexp_replace(F.trim(_col(text), F.lit(" \t\r\n")), RESPONSE_HEADING, "")


def display_label(name, prefix: str, upper: bool = False) -> Column:
    """A feature name for people: no prefix, and blanks or capitals as the chart wants."""
    bare = F.replace(_col(name), F.lit(prefix), F.lit(""))
    return F.upper(bare) if upper else F.replace(bare, F.lit("_"), F.lit(" "))
