from adlens.functions.coerce import fill_ranking, na_to_null, to_date_strict, to_number
from adlens.functions.ratios import ratio_or_zero, ratio_signed_inf, ratio_text_or_na
from adlens.functions.text import iso_date, money, money_plain, percent_plain, plain2, whole

__all__ = [
    "fill_ranking", "na_to_null", "to_date_strict", "to_number",
    "ratio_or_zero", "ratio_signed_inf", "ratio_text_or_na",
    "iso_date", "money", "money_plain", "percent_plain", "plain2", "whole",
]
