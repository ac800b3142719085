from .columns import (
    anomaly_text, clean_response, clock_text, comma_to_dash, display_label, hour_of_day,
    hour_gap_bucket, amount_ratio, percent_change, haversine_km, birth_year, decade_flag,
    decade_text, above_threshold, fixed_text,
)

__all__ = [
    "anomaly_text", "clean_response", "clock_text", "comma_to_dash", "display_label",
    "hour_of_day", "hour_gap_bucket", "amount_ratio", "percent_change", "haversine_km",
    "birth_year", "decade_flag", "decade_text", "above_threshold", "fixed_text",
]
