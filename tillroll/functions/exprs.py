"""Column expressions shared by the operators (all JVM-side, no UDFs).

Numeric contract (results must not depend on partitioning):
* money is summed as an exact decimal and cast to double once at the end;
* an average of money is that exact sum divided by a count;
* sample standard deviations are rounded to 6 decimals (the last bits of a
  double ``stddev_samp`` depend on the merge order of partial aggregates);
* division never raises: ``try_divide`` and ``coalesce(..., 0)`` stand in for
  the reference's "inf -> 0, NaN -> 0" clean-up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
HOLIDAY_NOV_FROM_DAY = 20      # 20-30 November
HOLIDAY_DEC_TO_DAY = 26        # 1-26 December
HOLIDAY_PRICE_FACTOR = "1.5"   # price multiplier on holiday days
SAFETY_Z_SIMPLE = 1.65         # simple safety stock factor
SERVICE_LEVEL = 0.95
Z_95 = 1.6448536269514715      # standard normal quantile at 0.95
LEAD_TIME_DAYS = 7
PAIR_MIN_SUPPORT = 0.03
STD_DIGITS = 6


def dec(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def money(price: Column, discount: Column) -> Column:
    """Exact line revenue ``price * (1 - discount)`` as decimal(38,4)."""
    return dec(price) * (F.lit(1) - dec(discount))


def to_double(c: Column) -> Column:
    return c.cast("double")


def exact_sum(c: Column) -> Column:
    """Sum of a decimal column, zero for an empty or all-null group."""
    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,4)"))


def money_sum(c: Column) -> Column:
    return to_double(exact_sum(c))


def is_holiday(date: Column) -> Column:
    m, d = F.month(date), F.dayofmonth(date)
    return ((m == 11) & (d >= HOLIDAY_NOV_FROM_DAY)) | ((m == 12) & (d <= HOLIDAY_DEC_TO_DAY))


def holiday_factor(flag: Column) -> Column:
    return F.when(flag, F.lit(HOLIDAY_PRICE_FACTOR).cast("decimal(2,1)")).otherwise(F.lit("1.0").cast("decimal(2,1)"))


def weekday(date: Column) -> Column:
    """Day of week with Monday = 0 (pandas ``dt.dayofweek``)."""
    return F.weekday(date).cast("int")


def is_weekend(date: Column) -> Column:
    return (F.weekday(date) >= 5).cast("int")


def calendar_columns(date: Column) -> dict[str, Column]:
    return {
        "day_of_week": weekday(date),
        "month": F.month(date).cast("int"),
        "quarter": F.quarter(date).cast("int"),
        "day_of_year": F.dayofyear(date).cast("int"),
        "is_weekend": is_weekend(date),
    }


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either side is null (inf/NaN -> 0)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def null_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def std6(c: Column) -> Column:
    return F.round(F.stddev_samp(c), STD_DIGITS)


def round6(c: Column) -> Column:
    return F.round(c, STD_DIGITS)
