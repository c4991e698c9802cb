"""Money and number expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: two amounts this close are the same amount.
MONEY_TOLERANCE = 0.01


def money_eq(a: Column, b: Column, tol: float = MONEY_TOLERANCE) -> Column:
    """Equal within the tolerance; both absent is equal, one absent is not."""
    return (F.when(a.isNull() & b.isNull(), True)
            .when(a.isNull() | b.isNull(), False)
            .otherwise(F.abs(a - b) <= tol))


def two_decimals(x: Column) -> Column:
    return F.format_string("%.2f", x)


def plain_number(x: Column) -> Column:
    """A double written without exponent, with at least one decimal; absent is ``None``.

    Spark switches to exponent form at ten million and below a thousandth, so such values go
    through DECIMAL; below a ten-thousandth the exponent form is meant.
    """
    small = F.regexp_replace(x.cast("decimal(28,20)").cast("string"), r"0+\z", "")
    wide = F.regexp_replace(x.cast("decimal(28,6)").cast("string"), r"(\.\d+?)0+\z", "$1")
    return (F.when(x.isNull(), "None")
            .when(F.abs(x) >= 1e7, wide)
            .when((F.abs(x) < 1e-3) & (F.abs(x) >= 1e-4), small)
            .otherwise(x.cast("string")))


def token_cost(tokens_in: Column, tokens_out: Column, in_price: Column, out_price: Column) -> Column:
    """Dollars for a call; prices are per million tokens."""
    return (tokens_in * in_price + tokens_out * out_price) / F.lit(1e6)


def score_round(x: Column, digits: int) -> Column:
    """Half-even rounding, the rule reported scores, costs and latencies follow."""
    return F.bround(x, digits)
