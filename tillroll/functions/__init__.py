from tillroll.functions.numeric import exact_round, exact_sum, pct, ratio, safe_div, share_of_total
from tillroll.functions.temporal import fractional_days, month_start, whole_days

__all__ = ["exact_round", "exact_sum", "pct", "ratio", "safe_div", "share_of_total",
           "fractional_days", "month_start", "whole_days"]
