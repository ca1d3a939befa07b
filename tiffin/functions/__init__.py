"""Column-expression helpers; all built-in Spark SQL functions (no UDFs)."""

from tiffin.functions.dates import as_of_date, in_any_year, in_year, month_text, year_range, years_before
from tiffin.functions.money import money_sums, money_value, rounded_ratio, sums_again
from tiffin.functions.timeofday import hour_of, seconds_of_day, slot_label, time_difference, wrapped_seconds

__all__ = [
    "as_of_date", "hour_of", "in_any_year", "in_year", "money_sums", "money_value", "month_text",
    "rounded_ratio", "seconds_of_day", "slot_label", "sums_again", "time_difference", "wrapped_seconds",
    "year_range", "years_before",
]
