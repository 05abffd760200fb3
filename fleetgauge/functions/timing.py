"""Time helpers. Text timestamps are UTC, so they are handled without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"
SECOND = 1_000_000_000  # nanoseconds


def utc_text(moment: Column) -> Column:
    """UTC text of an instant, whatever the zone of the session."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), TEXT_FORMAT)


def instant(text: Column) -> Column:
    """A UTC text timestamp as an instant."""
    return F.concat(text, F.lit("Z")).cast("timestamp")


def five_second_bucket(text: Column) -> Column:
    """Start of the five-second bucket of a text timestamp, as text.

    Minutes are a whole number of buckets, so flooring the two digits of the
    seconds is enough. Unlike `window()` this keeps rows without a timestamp,
    and it parses nothing.
    """
    seconds = F.substring(text, 18, 2).try_cast("int")
    return F.concat(F.substring(text, 1, 17), F.lpad((seconds - seconds % 5).cast("string"), 2, "0"))


def picos_to_seconds(picos: Column) -> Column:
    return picos.cast("double") / F.lit(1e12)


def picos_to_ms(picos: Column) -> Column:
    return picos.cast("double") / F.lit(1e9)


def span_nanos(oldest: Column, newest: Column) -> Column:
    """Nanoseconds between two picosecond timers; 0 when either is 0 or they do not increase."""
    known = (oldest != 0) & (newest != 0) & (newest > oldest)
    nanos = F.call_function("div", newest - oldest, F.lit(1000))
    return F.when(known, nanos).otherwise(F.lit(0).cast("bigint"))


def adjusted_interval(current: Column, span: Column) -> Column:
    """Next sampling interval in nanoseconds for a history that covers `span`.

    Under one and a half intervals the history is about to lose events, so the
    interval is halved; above four it grows by half. Only a changed interval is
    kept within one second and one minute.
    """
    ratio = F.when(current == 0, F.lit(float("inf"))).otherwise(
        span.cast("double") / F.nullif(current, F.lit(0).cast("bigint")).cast("double"))
    factor = F.when(ratio < 1.5, F.lit(0.5)).when(ratio > 4.0, F.lit(1.5))
    changed = (current.cast("double") * factor).cast("bigint")
    bounded = F.greatest(F.least(changed, F.lit(60 * SECOND)), F.lit(SECOND))
    return F.when((span == 0) | factor.isNull(), current).otherwise(bounded)
