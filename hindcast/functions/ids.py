"""Deterministic identifiers as columns.

A name-based (version 5) UUID is SHA-1 over namespace bytes and name, with the
version and variant bits set, so it needs no Python function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUE: RFC 4122 namespace for URLs.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"

DEFAULT_PREFIX = "hindcast"


def uuid5(name: Column) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def train_event_id(ticker: Column, calendar_date: Column, normalized: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    return train_event_id_from_digest(ticker, calendar_date, F.sha2(normalized, 256), prefix)


def train_event_id_from_digest(ticker: Column, calendar_date: Column, digest: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """Same id when the SHA-256 of the normalised headline is already at hand."""
    day = F.date_format(calendar_date, "yyyy-MM-dd")
    return uuid5(F.concat_ws(":", F.lit(f"{prefix}:train"), ticker, day, F.substring(digest, 1, 16)))


def event_point_id(event_id: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    return uuid5(F.concat(F.lit(f"{prefix}:event:"), event_id))


def rss_item_key(guid: Column, link: Column, title: Column, published_iso: Column) -> Column:
    """guid, else link, else a digest of title and time."""
    digest = F.substring(F.sha2(F.concat_ws("|", title, published_iso), 256), 1, 32)
    return F.coalesce(F.nullif(guid, F.lit("")), F.nullif(link, F.lit("")), digest)


def rss_event_id(ticker: Column, item_key: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    return uuid5(F.concat_ws(":", F.lit(f"{prefix}:rss"), ticker, item_key))
