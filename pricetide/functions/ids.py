"""Product ids and product urls."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide import fixed
from pricetide.functions.text import first_match, utf16_length


def product_id(url: Column) -> Column:
    """Unpadded base64url of the UTF-8 url."""
    encoded = F.regexp_replace(F.base64(F.encode(url, "UTF-8")), r"[\r\n=]", "")
    return F.translate(encoded, "+/", "-_")


# Unpadded base64url as an encoder writes it: no odd character left over, no stray bits in the last one.
_ENCODED = (
    rf"\A(?=.{{1,{fixed.MAX_ID_LENGTH}}}\z)(?:[A-Za-z0-9_-]{{4}})*"
    r"(?:[A-Za-z0-9_-][AQgw]|[A-Za-z0-9_-]{2}[AEIMQUYcgkosw048])?\z"
)


def _decoded(product: Column) -> Column:
    """The text an id holds, null where it is not base64url of UTF-8."""
    standard = F.translate(first_match(product, _ENCODED, 0), "-_", "+/")
    return F.try_validate_utf8(F.try_to_binary(standard, F.lit("base64")).cast("string"))


def product_id_error(product: Column) -> Column:
    """Why an id is refused; null for a good one."""
    url = _decoded(product)
    return (
        F.when(product.isNull() | (product == ""), "missing")
        .when(utf16_length(product) > fixed.MAX_ID_LENGTH, "too_long")
        .when(~F.rlike(product, F.lit(r"\A[A-Za-z0-9_-]+\z")), "alphabet")
        .when(url.isNull(), "malformed")
        .when(~F.rlike(url, F.lit(r"\Ahttps?://")), "not_http")
    )


def url_of_product_id(product: Column) -> Column:
    """The url an id stands for, null where the id is refused. Takes the steps of `product_id_error` in one chain."""
    return first_match(_decoded(product), r"(?s)\Ahttps?://.*\z", 0)


def canonical_product_url(raw: Column) -> Column:
    """The one spelling of a product page's url, null for anything that is not one.

    Written with patterns: Spark's url parser refuses urls with blanks, which browsers accept. "." and ".." segments of
    the path are resolved first, as browsers do, escaped dots included.
    """
    hosts = "|".join(host.replace(".", r"\.") for host in fixed.PRODUCT_HOSTS)
    product_page = (
        rf"(?i)\A[{fixed.SPACE}]*https?:[/\\]*(?:[^/\\?#]*@)?(?:{hosts})(?::[0-9]*)?"
        r"(?=[/\\])[^?#]*?[/\\]dp[/\\]([A-Z0-9]{10})"
    )
    code = first_match(_resolved(F.translate(raw, "\t\r\n", "")), product_page, 1)
    return F.concat(F.lit(fixed.PRODUCT_URL_PREFIX), F.upper(code), F.lit("/"))


_DOT = r"(?:\.|%2[eE])"
_URL_PARTS = r"(?s)\A([^?#]*?:[/\\]*[^/\\?#]*)([^?#]*)(.*)\z"


def _resolved(url: Column) -> Column:
    """The url with its path's dot segments resolved; urls without any are left as they are. Names its input once."""
    return F.get(F.transform(F.array(url), _without_dots), F.lit(0))


def _without_dots(url: Column) -> Column:
    dots = F.rlike(url, F.lit(rf"[/\\]{_DOT}{{1,2}}(?:[/\\?#]|\z)"))
    head, path, rest = (F.regexp_extract(url, _URL_PARTS, k) for k in (1, 2, 3))
    kept = F.aggregate(
        F.slice(F.split(path, r"[/\\]"), 2, 2**30), F.array().cast("array<string>"),
        lambda done, part: F.when(F.rlike(part, F.lit(rf"\A{_DOT}{{2}}\z")), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(F.rlike(part, F.lit(rf"\A{_DOT}\z")), done)
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.when(dots, F.concat(head, F.lit("/"), F.array_join(kept, "/"), rest)).otherwise(url)


def canonical_search_link(url: Column) -> Column:
    """Product links in their one spelling, other links as they are."""
    code = first_match(url, fixed.PRODUCT_LINK, 1)
    return F.coalesce(F.concat(F.lit(fixed.PRODUCT_URL_PREFIX), code, F.lit("/")), url)


def is_dead_redirect(url: Column, final_url: Column) -> Column:
    """A product url that ended somewhere else, unless on a page that blocks crawlers."""
    blocked = F.lit(False)
    for fragment in fixed.BLOCK_PAGE_FRAGMENTS:
        blocked = blocked | F.contains(final_url, F.lit(fragment))
    pattern = F.lit(fixed.PRODUCT_PATH)
    return F.rlike(url, pattern) & ~F.rlike(final_url, pattern) & ~blocked
