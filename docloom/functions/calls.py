"""Failures of model calls, from a log of them: which are worth another try, after how long, and of what kind they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def retryable(status: Column) -> Column:
    """No answer at all (null), too many requests, or the service's own fault."""
    return status.isNull() | (status == 429) | (status >= 500)


def retry_delay(attempt: Column, status: Column, retry_after: Column | None = None) -> Column:
    """Seconds before the next try without its random part; attempt counts from 0, a service's own wish wins."""
    own = F.when(retry_after.isNotNull(), F.least(F.lit(60.0), retry_after)) if retry_after is not None else F.lit(None).cast("double")
    power = F.pow(F.lit(2.0), attempt)
    return F.coalesce(own, F.when(status == 429, F.least(5 * power, F.lit(60.0))).otherwise(F.least(power, F.lit(30.0))))


def failure_kind(status: Column, exception: Column) -> Column:
    return F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(F.coalesce(exception, F.lit("invalid answer")))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """US dollars by prices per million tokens; null unless both prices are known."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 6)
