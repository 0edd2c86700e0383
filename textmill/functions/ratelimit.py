"""Rate limits read from response headers, and the rate that follows, as column expressions over a header map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds above this are a date; rates a second.
EPOCH_FROM, DEFAULT_RATE, LEAST_RATE, LOW_SHARE = 946_684_800, 5.0, 0.1, 0.1
#: Header names, the first set before the second.
SETS = (
    ("x-ratelimit-limit", "x-ratelimit-remaining", "x-ratelimit-reset"),
    ("ratelimit-limit", "ratelimit-remaining", "ratelimit-reset"),
)


def _first(headers: Column, name: str) -> Column:
    lower = F.transform_keys(headers, lambda k, v: F.lower(k))
    return F.trim(F.get(F.element_at(lower, F.lit(name)), F.lit(0)))


def reset_at(value: Column, now: Column) -> Column:
    """A count of seconds from now, or a date as seconds of the epoch; null if it is neither."""
    n = value.try_cast("bigint")
    return F.when(n > EPOCH_FROM, F.timestamp_seconds(n)).otherwise(F.timestamp_seconds(F.unix_timestamp(now) + n))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds, or the seconds until an HTTP date; past dates and bad values are 0."""
    date = F.try_to_timestamp(F.regexp_extract(value, "^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(value.try_cast("bigint"), F.unix_timestamp(date) - F.unix_timestamp(now), F.lit(0))
    return F.greatest(seconds, F.lit(0)).cast("double")


def parse(headers: Column, now: Column) -> Column:
    """struct(limit, remaining, reset_at, retry_after_s, found). The sets aren't mixed."""
    limit, remaining, reset, any_ = F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(None).cast("timestamp"), F.lit(False)
    for names in reversed(SETS):
        own = [_first(headers, n) for n in names]
        here = own[0].isNotNull() | own[1].isNotNull() | own[2].isNotNull()
        limit = F.when(here, own[0].try_cast("double")).otherwise(limit)
        remaining = F.when(here, own[1].try_cast("int")).otherwise(remaining)
        reset = F.when(here, reset_at(own[2], now)).otherwise(reset)
        any_ = here | any_
    retry = _first(headers, "retry-after")
    return F.struct(
        limit.alias("limit"), remaining.alias("remaining"), reset.alias("reset_at"),
        F.when(retry.isNotNull(), retry_after(retry, now)).otherwise(F.lit(0.0)).alias("retry_after_s"),
        (any_ | retry.isNotNull()).alias("found"),
    )


def header_rate(info: Column, now: Column) -> Column:
    """Requests a second: what remains over the window if it ends later, else the limit; half of it when little remains.

    Without a limit there is no rate from headers: 0.
    """
    window = (F.unix_timestamp(info["reset_at"]) - F.unix_timestamp(now)).cast("double")
    remaining = F.coalesce(info["remaining"], F.lit(0))
    rate = F.when(window > 0, remaining / window).otherwise(info["limit"])
    slowed = F.when(remaining / info["limit"] < LOW_SHARE, rate * 0.5).otherwise(rate)
    return F.when(info["limit"] > 0, F.greatest(slowed, F.lit(LEAST_RATE))).otherwise(F.lit(0.0))


def resolve_rate(explicit: Column, header: Column, crawl_delay_s: Column, default: Column) -> Column:
    """An explicit rate, else the headers', else one request in each crawl delay, else the default."""
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(explicit), positive(header), 1 / positive(crawl_delay_s), positive(default), F.lit(DEFAULT_RATE))


def backoff_s(attempt: int) -> float:
    """Wait before the attempt after this one: 0.5 s, then twice as long each time."""
    return 0.5 * 2 ** (attempt - 1)
