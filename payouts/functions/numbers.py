"""Brazilian numbers, percent scales and money arithmetic.

``text`` tells how the input column is typed: True for a text column, False for a
numeric one, or a boolean column when a sheet column mixes both kinds of cell.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from payouts.functions.text import NUMBER_PATTERN, strip
from payouts.schemas import (
    BALANCE_TOLERANCE,
    CLASSE_IMPLEMENTO,
    CLASSE_NOVOS,
    CLASSE_USADOS,
    PERCENT_TOLERANCE,
)

__all__ = [
    "classify_sale", "format_currency_br", "format_percent_br", "format_us", "gross_margin",
    "is_settled", "margin_pct", "matches_rule", "money_sum", "net_revenue", "parse_br_number",
    "parse_commission_points", "parse_margin_points", "parse_percent_points",
    "rate_read_percent", "rate_read_target", "safe_float", "weighted_mean",
]

_MONEY = "decimal(28,6)"


def _by_kind(text, when_text: Column, when_number: Column) -> Column:
    if isinstance(text, Column):
        return F.when(text, when_text).otherwise(when_number)
    return when_text if text else when_number


def safe_float(c: Column) -> Column:
    """DOUBLE with NaN read as missing."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def _text_number(c: Column) -> Column:
    bare = strip(F.replace(F.replace(strip(c), F.lit("R$")), F.lit("%")))
    dotted = F.replace(F.replace(bare, F.lit(".")), F.lit(","), F.lit("."))
    plain = F.when(F.contains(bare, F.lit(",")), dotted).otherwise(bare)
    return F.when(plain.rlike(NUMBER_PATTERN), plain.try_cast("double"))


def parse_br_number(c: Column, text=True) -> Column:
    """``R$ 1.234,50`` or ``5,00%`` to DOUBLE; NULL when it is no number."""
    return _by_kind(text, _text_number(c), safe_float(c))


def _fraction_to_points(number: Column) -> Column:
    return F.when((F.abs(number) <= 1) & (number != 0), number * 100).otherwise(number)


def parse_percent_points(c: Column, text=True) -> Column:
    """Percent points; a numeric cell within one is a spreadsheet fraction, text never is."""
    parsed = _by_kind(text, _text_number(c), _fraction_to_points(safe_float(c)))
    return F.coalesce(parsed, F.lit(0.0))


def parse_commission_points(c: Column, text=True) -> Column:
    """Percent points; values above ten are old imports kept times hundred."""
    number = parse_br_number(c, text)
    return F.coalesce(F.when(F.abs(number) > 10, number / 100).otherwise(number), F.lit(0.0))


def parse_margin_points(c: Column, text=True) -> Column:
    """Margin-target points; text with a percent sign is final, any other fraction is scaled."""
    from_text = _text_number(c)
    scaled_text = F.when(F.contains(c.cast("string"), F.lit("%")), from_text).otherwise(
        _fraction_to_points(from_text)
    )
    parsed = _by_kind(text, scaled_text, _fraction_to_points(safe_float(c)))
    return F.coalesce(parsed, F.lit(0.0))


def rate_read_percent(c: Column) -> Column:
    """Stored commission percent as it is read: the above-ten rule on a number."""
    number = c.cast("double")
    return F.when(F.abs(number) > 10, number / 100).otherwise(number)


def rate_read_target(c: Column) -> Column:
    """Stored target or manager percent as it is read: the fraction rule on a number."""
    return _fraction_to_points(c.cast("double"))


def format_us(c: Column) -> Column:
    """1,234.50, the form used inside detail texts."""
    return F.format_number(c, 2)


def _swap_marks(c: Column) -> Column:
    return F.translate(F.format_number(safe_float(c), 2), ",.", ".,")


def format_currency_br(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("R$ "), _swap_marks(c)), F.lit(""))


def format_percent_br(c: Column) -> Column:
    return F.coalesce(F.concat(_swap_marks(c), F.lit("%")), F.lit(""))


def money_sum(c: Column) -> Column:
    """Exact total, the same for any row order or task retry; NULL only when nothing adds up.

    A missing amount, NaN included, adds nothing. One that does not fit, infinity included,
    fails the query under ANSI mode: no amount leaves a total unnoticed.
    """
    value = c.cast("double")
    endless = F.raise_error(F.lit("an infinite amount cannot be summed")).cast(_MONEY)
    exact = F.when(F.isnan(value), None).when(F.abs(value) == float("inf"), endless).otherwise(c.cast(_MONEY))
    return F.sum(exact).cast("double")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum(value * weight) / Sum(weight), zero when the weights cancel out."""
    return F.coalesce(money_sum(value * weight) / F.nullif(money_sum(weight), F.lit(0.0)), F.lit(0.0))


def is_settled(balance: Column) -> Column:
    return F.abs(balance) < BALANCE_TOLERANCE


def classify_sale(category: Column, state: Column) -> Column:
    """Sale class; the implement category wins over the machine state."""
    kind, condition = F.upper(F.trim(category)), F.upper(F.trim(state))
    return (
        F.when(kind == "IP", F.lit(CLASSE_IMPLEMENTO))
        .when(condition == "NOVO", F.lit(CLASSE_NOVOS))
        .when(condition == "USADO", F.lit(CLASSE_USADOS))
    )


def _amount(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def gross_margin(total: Column, tax: Column, cost: Column) -> Column:
    """Margin by the sign of the total, for invoices and returns alike."""
    t, x, k = _amount(total), _amount(tax), _amount(cost)
    return F.when(t >= 0, t - x - k).otherwise(t * -1 + x + k)


def net_revenue(total: Column, tax: Column, net_sale: Column | None = None) -> Column:
    """Net sale as invoiced, or the negated total less tax when the row is a return."""
    return _amount(net_sale) if net_sale is not None else _amount(total) * -1 - _amount(tax)


def margin_pct(margin: Column, net: Column) -> Column:
    return F.coalesce(margin / F.nullif(net, F.lit(0.0)) * 100, F.lit(0.0))


def matches_rule(value: Column, allowed: Column) -> Column:
    """True when some allowed value lies within the percent tolerance."""
    near = F.exists(allowed, lambda e: F.abs(value - e) <= PERCENT_TOLERANCE)
    return F.coalesce(near, F.lit(False))
