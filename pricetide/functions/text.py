"""Page text to values, names and search links."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions.money import iso_currency


def strip(text: Column) -> Column:
    """Trim all white space, no-break spaces included."""
    return F.btrim(text, F.lit(fixed.SPACES))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def first_match(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null where there is none.

    Names its input once. Spark copies the expression behind a column into the filters and join keys that use the
    column, so an expression that repeats its input grows with every step built on it.
    """
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(1))


def parse_price(text: Column) -> Column:
    """'1 299,00 €' to (1299.0, EUR); null unless there are decimals. A symbol counts only right before the digits."""
    symbol = F.regexp_extract(text, fixed.PRICE_TEXT, 1)
    number = F.regexp_extract(text, fixed.PRICE_TEXT, 2)
    amount = F.translate(F.regexp_replace(number, f"[{fixed.SPACE}]", ""), ",", ".").try_cast("double")
    currency = iso_currency(F.when(symbol == "", "€").otherwise(symbol))
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), currency.alias("currency")))


def parse_unit_price(text: Column) -> Column:
    """'(3,18 €/l)' to (3.18, 'l'); the unit is '' where none follows."""
    number = F.regexp_extract(text, fixed.UNIT_PRICE_AMOUNT, 1)
    amount = F.translate(number, ",", ".").try_cast("double")
    unit = strip(F.regexp_extract(text, fixed.UNIT_PRICE_UNIT, 1))
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), unit.alias("unit")))


def high_res_image(url: Column) -> Column:
    return F.regexp_replace(url, fixed.IMAGE_SIZE_SUFFIX, "$1.$2")


def high_res_images(urls: Column) -> Column:
    return F.array_distinct(F.transform(urls, high_res_image))


def contains_ignoring_case(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def keyword_name(raw: Column) -> Column:
    """The trimmed name, null where it is not acceptable."""
    name = strip(raw)
    return F.when((name != "") & (utf16_length(name) <= fixed.MAX_KEYWORD_LENGTH), name)


def search_url(keyword: Column) -> Column:
    """Percent-encoded as in a query string, with the marks ! ' ( ) left alone and spaces as %20."""
    encoded = F.replace(F.url_encode(keyword), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(mark))
    return F.concat(F.lit(fixed.SEARCH_URL), encoded)
