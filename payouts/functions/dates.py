"""Dates and commission periods (16th of the base month to the 15th of the next)."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from payouts.functions.text import strip
from payouts.schemas import MONTH_NAMES

__all__ = [
    "commission_period", "default_period", "infer_period_label", "label_base", "month_label",
    "parse_date_br", "period_of_date", "period_of_label", "period_options",
]


def parse_date_br(c: Column, text: bool = True) -> Column:
    """Day-first text to DATE (ISO text also reads); NULL when it is no date."""
    if not text:
        return c.cast("date")
    value = strip(c)
    return F.coalesce(F.try_to_date(value, "d/M/yyyy"), F.try_to_date(value, "yyyy-MM-dd"))


def month_label(d: Column) -> Column:
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.concat(F.element_at(names, F.month(d)), F.lit("/"), F.year(d).cast("string"))


def commission_period(base_month: Column) -> Column:
    """Struct of the period whose base month starts at ``base_month`` (a first-of-month DATE)."""
    start = F.date_add(F.trunc(base_month, "MM"), 15)
    end = F.date_add(F.add_months(F.trunc(base_month, "MM"), 1), 14)
    return F.struct(
        month_label(end).alias("label"),
        F.year(start).alias("base_year"),
        F.month(start).alias("base_month"),
        start.alias("start_date"),
        end.alias("end_date"),
    )


def label_base(label: str) -> tuple[int, int] | None:
    """(year, month) of the base month of a label, which names the month after it."""
    name, _, year = label.partition("/")
    if name not in MONTH_NAMES or not year.isdigit():
        return None
    month = MONTH_NAMES.index(name)
    return (int(year), month) if month else (int(year) - 1, 12)


def period_of_label(label: Column) -> Column:
    """Struct of the period that a label names; NULL when it names none."""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    month = F.nullif(F.array_position(names, F.substring_index(label, "/", 1)), F.lit(0)).cast("int")
    ends = F.make_date(F.substring_index(label, "/", -1).try_cast("int"), month, F.lit(1))
    return F.when(ends.isNotNull(), commission_period(F.add_months(ends, -1)))


def period_of_date(d: Column) -> Column:
    """Base month (first day) of the period a date falls into."""
    return F.trunc(F.add_months(d, F.when(F.dayofmonth(d) >= 16, 0).otherwise(-1)), "MM")


def default_period(reference: Column) -> Column:
    """Base month whose window has just closed."""
    return F.trunc(F.add_months(reference, -1), "MM")


def period_options(reference: Column, years_back: int = 1, years_ahead: int = 1) -> Column:
    """Array of the base months of the years around the reference date."""
    year = F.year(reference)
    first = F.make_date(year - years_back, F.lit(1), F.lit(1))
    last = F.make_date(year + years_ahead, F.lit(12), F.lit(1))
    return F.sequence(first, last, F.expr("interval 1 month"))


def infer_period_label(file_name: Column, known: Sequence[str], default: str) -> Column:
    """Period label from a dd-mm-yyyy in a file name when that label is on offer."""
    pattern = r"([0-9]{2})[-_/]([0-9]{2})[-_/]([0-9]{4})"
    month = F.regexp_extract(file_name, pattern, 2).try_cast("int")
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    name = F.try_element_at(names, F.when(month > 0, month))
    label = F.concat(name, F.lit("/"), F.regexp_extract(file_name, pattern, 3).try_cast("int").cast("string"))
    return F.when(label.isin(*known), label).otherwise(F.lit(default)) if known else F.lit(default)
