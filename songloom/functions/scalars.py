"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from songloom import schemas

# The numeric literals a browser accepts when it turns text into a number.
DECIMAL_LITERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_LITERAL = r"^[+-]?Infinity$"
RADIX_LITERALS = {16: r"^0[xX][0-9a-fA-F]+$", 8: r"^0[oO][0-7]+$", 2: r"^0[bB][01]+$"}

# Fixed value: where a track search response holds its first cover.
COVER_PATH = "$.tracks.items[0].album.images[0].url"


def to_number(text: Column | str) -> Column:
    """Text to double the way a browser does it: blank is 0, other non-numbers are null."""
    value = F.col(text) if isinstance(text, str) else text
    trimmed = F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")
    number = F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0.0)).when(
        trimmed.rlike(DECIMAL_LITERAL) | trimmed.rlike(INFINITY_LITERAL),
        trimmed.try_cast("double"),
    )
    for radix, pattern in RADIX_LITERALS.items():
        number = number.when(trimmed.rlike(pattern), _folded(F.substring(trimmed, 3, F.length(trimmed)), radix))
    return number


def _folded(digits: Column, radix: int) -> Column:
    """The value of digits of any number, as a double."""
    values = F.transform(
        F.split(F.lower(digits), ""), lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1
    )
    return F.aggregate(
        F.filter(values, lambda v: v >= 0), F.lit(0.0), lambda total, v: total * radix + v
    )


def short_label(text: Column | str, length: int = 5) -> Column:
    """First characters of a label followed by three dots, whatever its length."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def format_rating(rating: Column | str, digits: int = 2) -> Column:
    """Rating as text, rounded by the value of the double and not by its decimal text.

    Only where the product with the power of ten seems to be a half does its rounding error,
    computed without error in two parts, decide; an exact half goes to the even digit. A minus
    sign survives rounding. Null stays null; values too large for a fraction are printed as they are.
    """
    value = (F.col(rating) if isinstance(rating, str) else rating).cast("double")
    unit, scale = 10**digits, float(10**digits)
    size = F.abs(value)
    before = F.floor(size)
    fraction = size - before
    product = fraction * scale
    spread = fraction * 134217729.0  # 2 ** 27 + 1 cuts a double into two halves
    high = spread - (spread - fraction)
    error = (high * scale - product) + (fraction - high) * scale
    whole = F.floor(product)
    part = product - whole
    odd = (before % 2 * unit + whole) % 2 == 1
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & odd)))
    cents = whole + F.when(up, 1).otherwise(0)
    carried = before + F.floor(cents / unit)
    text = F.format_string(f"%d.%0{digits}d", carried, cents % unit) if digits else carried.cast("string")
    plain = F.format_string(f"%.{digits}f", size)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(value.isNotNull(), F.concat(sign, F.when(size < 2.0**62, text).otherwise(plain)))


def cover_url(body: Column | str) -> Column:
    """Cover address of the first track in a stored search response, null if it has none."""
    return F.get_json_object(body, COVER_PATH)


def cover_request(title: Column | str, base: str) -> Column:
    """Search address for a title, with the title percent-encoded."""
    value = F.col(title) if isinstance(title, str) else title
    encoded = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(base), encoded, F.lit("&type=track"))


def song_struct(listens: bool = False) -> Column:
    """The attributes of a song that a playlist entry keeps."""
    entry = schemas.SONG_ENTRY_WITH_LISTENS if listens else schemas.SONG_ENTRY
    return F.struct(*entry.names)
