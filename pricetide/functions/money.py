"""Prices: discounts, scores, rounding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide import fixed


def round_exact(value: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value, so 2.675 gives 2.67.

    `bround` works on the shortest decimal form instead and gives 2.68; `format_number` looks at the binary value.
    """
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).try_cast("double")


def round_half_up(value: Column) -> Column:
    """Nearest integer, halves upwards (-2.5 gives -2)."""
    whole = F.floor(value)
    return whole + F.when(value - whole >= 0.5, 1).otherwise(0)


def deal_score(mean_price: Column, price: Column) -> Column:
    """Per cent below the mean, to one decimal; null when the mean is zero or unknown."""
    return round_exact(F.try_divide(mean_price - price, mean_price) * 100, 1)


def predicted_price(mean_price: Column) -> Column:
    return round_exact(mean_price, 2)


def is_deal(score: Column) -> Column:
    return F.coalesce(score, F.lit(fixed.UNSCORED)) >= fixed.DEAL_SCORE_THRESHOLD


def discount_ratio(price: Column, crossed_out: Column) -> Column:
    """Share taken off the crossed-out amount; 0 unless both amounts are positive."""
    return F.when((crossed_out > 0) & (price > 0), 1 - price / crossed_out).otherwise(0.0)


def discount_percent(price: Column, crossed_out: Column) -> Column:
    return round_half_up((1 - F.try_divide(price, crossed_out)) * 100)


def complete_money(money: Column) -> Column:
    """The struct where both members are known, else null."""
    return F.when(money["amount"].isNotNull() & money["currency"].isNotNull(), money)


def complete_unit_price(unit_price: Column) -> Column:
    return F.when(unit_price["amount"].isNotNull() & unit_price["unit"].isNotNull(), unit_price)


def finite(number: Column) -> Column:
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def known_trend(trend: Column) -> Column:
    return F.when(trend.isin(*fixed.TRENDS), trend)


def iso_currency(symbol: Column) -> Column:
    """ISO code of a currency symbol; null for anything else."""
    pairs = [F.lit(part) for pair in fixed.CURRENCY_BY_SYMBOL.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), symbol)
