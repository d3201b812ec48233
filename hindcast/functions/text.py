"""Headline text as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split/strip whitespace: Unicode White_Space plus the four
# information separators.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def squeeze(text: Column) -> Column:
    """Every run of whitespace becomes one blank; ends are stripped."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def strip(text: Column) -> Column:
    """Drop whitespace at both ends and leave the inside alone."""
    return F.regexp_extract(text, r"(?Us)^[\s\x1c-\x1f]*(.*[^\s\x1c-\x1f])?", 1)


def is_blank(text: Column) -> Column:
    """Stops at the first character that is not whitespace."""
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def normalize_headline(text: Column) -> Column:
    return F.lower(squeeze(text))


def normalize_ticker(text: Column) -> Column:
    return F.upper(strip(text))


def source_row_hash(date: Column, stock: Column, headline: Column) -> Column:
    """Fingerprint of the row as it stood in the archive (raw symbol)."""
    return F.sha2(F.concat_ws("|", date, stock, headline), 256)


def lexicon_sentiment(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative) / matched words, in [-1, 1]; 0.0 with no match."""
    words = F.split(F.lower(squeeze(text)), r"[^\p{L}\p{N}]+")
    pos = F.size(F.filter(words, lambda w: w.isin(positive)))
    neg = F.size(F.filter(words, lambda w: w.isin(negative)))
    return F.coalesce((pos - neg) / F.nullif(pos + neg, F.lit(0)), F.lit(0.0))


def fixed(value: Column, places: int) -> Column:
    """A number as text with so many decimals, as C and Python print it.

    They round the exact binary value, ties to even; `format_string` rounds the
    shortest decimal that reads back as the number, half up: 0.00375 is 0.0037 here
    and 0.0038 there. The remainder to a half is exact: the fraction is split in two
    short parts, whose products with a small integer have no rounding error.

    What is used more than once is bound to a name. Written out at every use it makes
    generated code of more than 8000 bytes, which the JVM never compiles.
    """
    scale = float(2 * 10**places)

    def up(part: Column, steps: Column) -> Column:
        wide = part * 134217729.0
        head = wide - (wide - part)
        rest = (head * scale - (2 * steps + 1)) + (part - head) * scale
        return bound(rest, lambda r: F.when((r > 0) | ((r == 0) & (steps % 2 == 1)), 1).otherwise(0))

    def shown(whole: Column, steps: Column) -> Column:
        digits = F.lpad((steps % 10**places).cast("string"), places, "0")
        return F.concat((whole + F.floor(steps / 10**places)).cast("string"), F.lit("."), digits)

    whole = F.floor(F.abs(value))
    text = bound(
        F.abs(value) - whole,
        lambda part: bound(F.floor(part * 10**places), lambda steps: bound(steps + up(part, steps), lambda n: shown(whole, n))),
    )
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    # Away from a half a number pattern rounds alike, and is quick.
    wide = F.abs(value) * 10**places
    clear = (wide < 1e13) & (F.abs(wide - F.floor(wide) - 0.5) > 0.001)
    plain = F.call_function("format_number", value + 0.0, F.lit("0." + "0" * places))
    # Doubles from 2**53 on have no fraction.
    return F.when(clear, plain).when(F.abs(value) < 2.0**53, F.concat(sign, text)).otherwise(F.format_string(f"%.{places}f", value))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]
