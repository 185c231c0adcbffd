"""Hybrid-logical-clock stamps and the canonical event order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of events. Instant, clock node, clock counter, author
# node, stream position; the event id last makes equal stamps deterministic.
ORDER_COLUMNS = (
    "hlc_us",
    "hlc_ns",
    "hlc_node",
    "hlc_seq",
    "node_uuid",
    "stream_seq",
    "event_uuid",
)

# Fixed value: an RFC 3339 instant (date, time, optional fraction, zone).
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})$"
# Fixed value: a canonical ULID, Crockford base 32 without I, L, O, U; 128 bits.
ULID = r"^[0-7][0-9A-HJKMNP-TV-Z]{25}$"


def order_key(prefix: str = "") -> Column:
    """The canonical order of events as one comparable struct."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in ORDER_COLUMNS])


def order_by() -> list[Column]:
    return [F.col(c) for c in ORDER_COLUMNS]


def is_ulid(text: Column) -> Column:
    return F.upper(text).rlike(ULID)


def instant_us(text: Column) -> Column:
    """Epoch microseconds of an RFC 3339 text, NULL when it is malformed."""
    return F.when(text.rlike(RFC3339), F.unix_micros(F.try_to_timestamp(F.upper(text))))


def sub_micro_ns(text: Column) -> Column:
    """Digits seven to nine of the fraction: what a microsecond clock drops."""
    digits = F.regexp_extract(text, r"\.(\d{1,9})", 1)
    return F.substring(F.rpad(digits, 9, "0"), 7, 3).cast("int")


def parse_hlc(text: Column) -> Column:
    """``<instant>/<node>/<seq>`` to a struct; NULL unless all three parts parse."""
    part = F.split(text, "/")
    at, node, seq = F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.get(part, F.lit(2))
    us = instant_us(at)
    count = seq.try_cast("bigint")
    good = (
        (F.size(part) == 3)
        & us.isNotNull()
        & is_ulid(node)
        & seq.rlike(r"^\+?\d+$")
        & count.isNotNull()
    )
    return F.when(
        good,
        F.struct(
            us.alias("us"),
            sub_micro_ns(at).alias("ns"),
            F.upper(node).alias("node"),
            count.alias("seq"),
        ),
    )


def format_hlc(us: Column, node: Column, seq: Column) -> Column:
    """Wire form with a counter of at least four digits."""
    at = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat(at, F.lit("/"), node, F.lit("/"), pad_seq(seq))


def pad_seq(seq: Column) -> Column:
    text = seq.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
