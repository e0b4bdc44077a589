"""The 14 features of a transaction as column expressions (V0 to V13).

All stay in generated code; nothing depends on the session's time zone. A row that lacks a
required field or has an unreadable timestamp gets a null vector, so that it takes the fallback.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.schema import SENTINEL, Normalisation, Risk


def clamp(x: Column) -> Column:
    """x limited to [0, 1]; NaN, whose code is 0, becomes 0; null stays null (least and greatest would skip it)."""
    return F.when(F.isnan(x) | (x < 0), 0.0).when(x > 1, 1.0).otherwise(x)


def ratio(a: Column, b: Column, divisor: float) -> Column:
    """clamp(a / b / divisor) with a zero b as in floating-point arithmetic: 1 for a > 0, else 0."""
    by_zero = F.when(a > 0, 1.0).otherwise(0.0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(clamp(F.try_divide(a, b) / divisor))


def micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO timestamp in UTC; null if it can't be read."""
    at = F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z"))))
    return F.unix_micros(at)


def hour_of(us: Column) -> Column:
    return F.floor(F.pmod(us, F.lit(86_400_000_000)) / 3_600_000_000).cast("double") / 23.0


def weekday_of(us: Column) -> Column:
    """Monday 0 to Sunday 6, over 6: the day 0 was a Thursday."""
    return F.pmod(F.floor(us / 86_400_000_000) + 3, F.lit(7)).cast("double") / 6.0


def risk_of(mcc: Column, risk: Risk = Risk()) -> Column:
    table = F.create_map(*[F.lit(x) for pair in risk.by_mcc.items() for x in pair])
    return F.coalesce(F.element_at(table, mcc), F.lit(risk.default))


def features(norm: Normalisation = Normalisation(), risk: Risk = Risk(), now: Column | None = None, last: Column | None = None) -> list[Column]:
    """V0 to V13 over the columns of a payload; now, last: its timestamps in microseconds, if they are columns already."""
    c = F.col
    amount, home = c("transaction.amount"), c("terminal.km_from_home")
    now = micros(c("transaction.requested_at")) if now is None else now
    last = micros(c("last_transaction.timestamp")) if last is None else last
    none = c("last_transaction").isNull()
    minutes = F.floor((now - last) / 1_000_000).cast("double") / 60.0
    known = c("customer.known_merchants")
    return [
        clamp(amount / norm.max_amount),
        clamp(c("transaction.installments").cast("double") / norm.max_installments),
        ratio(amount, c("customer.avg_amount"), norm.amount_vs_avg_ratio),
        hour_of(now),
        weekday_of(now),
        F.when(none, SENTINEL).otherwise(clamp(minutes / norm.max_minutes)),
        F.when(none, SENTINEL).otherwise(clamp(c("last_transaction.km_from_current") / norm.max_km)),
        clamp(home / norm.max_km),
        clamp(c("customer.tx_count_24h").cast("double") / norm.max_tx_count_24h),
        c("terminal.is_online").cast("double"),
        c("terminal.card_present").cast("double"),
        F.when(known.isNull(), F.lit(None).cast("double")).when(F.array_contains(known, c("merchant.id")), 0.0).otherwise(1.0),
        F.when(c("merchant.mcc").isNull(), F.lit(None).cast("double")).otherwise(risk_of(c("merchant.mcc"), risk)),
        clamp(c("merchant.avg_amount") / norm.max_merchant_avg_amount),
    ]


def vectorize(payloads: DataFrame, norm: Normalisation = Normalisation(), risk: Risk = Risk()) -> DataFrame:
    """Payload rows with a column `vector`; null where a required value is missing.

    Timestamps and values are columns of steps of their own, so that each is made once a row.
    """
    rows = payloads.withColumns({"__now": micros(F.col("transaction.requested_at")), "__last": micros(F.col("last_transaction.timestamp"))})
    names = [f"__v{i}" for i in range(14)]
    rows = rows.withColumns(dict(zip(names, features(norm, risk, F.col("__now"), F.col("__last")), strict=True)))
    whole = reduce(and_, [F.col(x).isNotNull() for x in names])
    return rows.withColumn("vector", F.when(whole, F.array(*names))).drop("__now", "__last", *names)
