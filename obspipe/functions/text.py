"""Text functions with Unicode semantics, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def py_strip(c: Column) -> Column:
    """Strip all Unicode white space, not only U+0020."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(py_strip(c), F.lit(""))


def matched(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def plain_url(c: Column) -> Column:
    """What a URL splitter reads: no tabs or line ends inside, no control characters or spaces in front."""
    return F.regexp_replace(F.regexp_replace(c, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def url_host(c: Column) -> Column:
    """Lower-case host of a URL, without user and port; null if there is none."""
    authority = F.regexp_extract(plain_url(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    host = F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1))
    return F.nullif(F.lower(host), F.lit(""))


def canonical_url(c: Column) -> Column:
    """scheme://authority/path in canonical form; null unless http(s) with an authority."""
    url = plain_url(py_strip(c))
    pattern = r"(?i)^(https?)://([^/?#]+)([^?#]*)"
    part = lambda i: F.regexp_extract(url, pattern, i)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when(url.rlike(pattern), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often `use` reads it; works inside lambdas, too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_price(raw: Column, currency_raw: Column) -> Column:
    """Struct (amount, currency). A symbol decides the currency; a plain number needs a known currency_raw."""
    number = rf"(?U)^{SPACE}*(-)?{SPACE}*([£$])?{SPACE}*(\d+(?:\.\d+)?){SPACE}*\z"

    def read(p: Column) -> Column:
        """p: minus, symbol and digits; null where nothing matches."""
        sign, symbol, size = p["sign"], p["symbol"], F.nullif(p["digits"], F.lit("")).try_cast("decimal(38,18)")
        currency = F.when(symbol == "£", "GBP").when(symbol == "$", "USD").when(p["named"].isin("GBP", "USD"), p["named"])
        amount = F.when(sign == "-", -size).otherwise(size).cast("decimal(38,18)")
        return let(F.struct(amount.alias("amount"), currency.alias("currency")), lambda x: F.struct(
            F.when(x["currency"].isNotNull(), x["amount"]).alias("amount"), F.when(x["amount"].isNotNull(), x["currency"]).alias("currency")))

    part = lambda i: F.regexp_extract(raw, number, i)
    return let(F.struct(part(1).alias("sign"), part(2).alias("symbol"), part(3).alias("digits"), F.upper(py_strip(currency_raw)).alias("named")), read)


def parse_availability(source: Column, raw: Column) -> Column:
    """Struct (availability, quantity) by the source's wording."""
    out = rf"(?iU)^{SPACE}*Out of stock{SPACE}*\z"
    books = rf"(?iU)^{SPACE}*In stock(?:{SPACE}*\((\d+) available\))?{SPACE}*\z"
    woo = rf"(?iU)^{SPACE}*(\d+){SPACE}+in stock{SPACE}*\z"
    flag = F.lower(py_strip(raw))
    js = source.isin("scrapify_js", "scraping_sandbox")
    is_books, is_woo = (source == "books_to_scrape") & raw.rlike(books), (source == "scrapeme_live") & raw.rlike(woo)
    availability = (
        F.when(raw.rlike(out), "OUT_OF_STOCK").when(is_books | is_woo, "IN_STOCK")
        .when(js & (flag == "true"), "IN_STOCK").when(js & (flag == "false"), "OUT_OF_STOCK")
    )
    quantity = (
        F.when(raw.rlike(out), F.lit(0).cast("long"))
        .when(is_books, matched(raw, books, 1).try_cast("bigint")).when(is_woo, matched(raw, woo, 1).try_cast("bigint"))
    )
    return F.struct(availability.alias("availability"), quantity.alias("quantity"))
