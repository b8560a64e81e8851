"""Strict localized prices: accept known grouping and decimal styles, refuse to guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, squash_ws

# The currency marks that may surround an amount.
CURRENCY = r"(?iu)(?:₽|руб\.?|р\.|rub|rur)"

ACCEPTED = (
    r"^(?:[0-9]+"  # plain
    r"|[0-9]+[.,][0-9]{1,2}"  # one decimal mark
    r"|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?"  # commas group
    r"|[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]{1,2})?)$"  # points group
)
NUMERIC_SHAPE = r"^[0-9]+(?:[.,][0-9]+)*$"
GROUP_MARK = r"[.,](?=[0-9]{3}(?:[.,]|$))"
PRICE_TYPE = "decimal(18,2)"


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, CURRENCY, ""), WHITESPACE, "")


def parse_price(text: Column) -> Column:
    """Amount as decimal, or null when the text is not exactly one accepted amount."""
    bare = _bare(text)
    number = F.translate(F.regexp_replace(bare, GROUP_MARK, ""), ",", ".")
    return F.when(bare.rlike(ACCEPTED), number).try_cast(PRICE_TYPE)


def price_error(text: Column) -> Column:
    """``unrecognised`` or ``ambiguous`` where :func:`parse_price` gives no amount."""
    return F.when(
        parse_price(text).isNull(),
        F.when(F.coalesce(_bare(text), F.lit("")).rlike(NUMERIC_SHAPE), "ambiguous").otherwise("unrecognised"),
    )


def format_price(value: Column, text: Column) -> Column:
    """Integral amounts as ``1 920 000 ₽``; anything else keeps its squashed text."""
    grouped = F.translate(F.format_number(value, 0), ",", " ")
    return F.when(value == F.floor(value), F.concat(grouped, F.lit(" ₽"))).otherwise(F.coalesce(squash_ws(text), F.lit("")))


def normalize_article(value: Column, cell_type: Column) -> Column:
    """Numeric cells lose a zero fraction; text cells keep leading zeros."""
    number = value.try_cast("decimal(38,10)")
    integral = (cell_type == "n") & (number == F.floor(number))
    return F.when(integral, F.floor(number).cast("decimal(28,0)").cast("string")).otherwise(squash_ws(value))
