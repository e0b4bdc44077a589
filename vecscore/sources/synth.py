"""Synthetic transactions of three profiles, drawn per row from hashes of (seed, id, field).

Any partition can make any row, in any order, and always the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.schema import Risk

# Ranges by profile (legit, fraud, borderline); integer ranges exclude their end.
AMOUNT = ((10.0, 500.0), (2000.0, 10000.0), (400.0, 3000.0))
INSTALLMENTS = ((1, 3), (6, 12), (3, 7))
HOUR = ((8, 20), (0, 6), (6, 22))
AVERAGE = (None, (50.0, 300.0), (100.0, 500.0))
COUNT = ((1, 5), (8, 20), (4, 11))
MCC = (("5411", "5812", "5912", "5311"), ("7995", "7801", "7802"), tuple(Risk().by_mcc))
MERCHANT = ((30.0, 500.0), (20.0, 100.0), (50.0, 300.0))
ONLINE = (0.3, 0.8, 0.5)
HOME = ((0.0, 50.0), (200.0, 1000.0), (30.0, 400.0))
UNKNOWN = (0.0, 1.0, 0.5)
LAST = ((0.0, 20.0), (200.0, 1000.0), (20.0, 300.0))
CARD, HISTORY = 0.9, 0.8
FIRST_DAY, DAYS = "2026-03-01", 1767


def generate(spark: SparkSession, n: int, fraud_ratio: float = 0.3, seed: int = 1) -> DataFrame:
    """n payload rows with their profile: legit 1 - r, fraud r - r / 10, borderline r / 10."""
    u = lambda field: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "n", F.lit(field)), 11) / float(1 << 53))

    def pick(table: tuple, make) -> Column:
        return F.when(F.col("profile") == "legit", make(table[0])).when(F.col("profile") == "fraud", make(table[1])).otherwise(make(table[2]))

    real = lambda table, field: pick(table, lambda x: x[0] + u(field) * (x[1] - x[0]))
    whole = lambda table, field: pick(table, lambda x: F.floor(x[0] + u(field) * (x[1] - x[0])).cast("int"))
    cents = lambda x: F.round(x, 2)
    profile = F.when(u("profile") < 1 - fraud_ratio, "legit").when(u("profile") < 1 - fraud_ratio / 10, "fraud").otherwise("borderline")
    rows = spark.range(n).withColumnRenamed("id", "n").withColumn("profile", profile).withColumn("amount", cents(real(AMOUNT, "amount")))
    average = F.when(F.col("profile") == "legit", F.col("amount") * 2).otherwise(cents(pick((AVERAGE[1], AVERAGE[1], AVERAGE[2]), lambda x: x[0] + u("average") * (x[1] - x[0]))))
    mcc = pick(MCC, lambda x: F.element_at(F.array(*map(F.lit, x)), F.floor(u("mcc") * len(x)).cast("int") + 1))
    at = F.unix_timestamp(F.lit(FIRST_DAY), "yyyy-MM-dd") + F.floor(u("day") * DAYS) * 86_400 + whole(HOUR, "hour") * 3_600 + F.floor(u("second") * 3_600)
    iso = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    online = u("online") < pick(ONLINE, F.lit)
    merchant = F.concat(F.lit("MERC-"), F.lpad(F.floor(u("merchant") * 900 + 100).cast("string"), 3, "0"))
    known = F.when(u("unknown") < pick(UNKNOWN, F.lit), F.array(F.lit("MERC-001"))).otherwise(F.array(F.lit("MERC-001"), merchant))
    last = F.struct(iso(at - F.floor(u("age") * 3650 * 86_400)).alias("timestamp"), cents(real(LAST, "last")).alias("km_from_current"))
    return rows.select(
        F.concat(F.lit("tx-"), "n").alias("id"), F.col("profile"),
        F.struct(F.col("amount"), whole(INSTALLMENTS, "installments").alias("installments"), iso(at).alias("requested_at")).alias("transaction"),
        F.struct(average.alias("avg_amount"), whole(COUNT, "count").alias("tx_count_24h"), known.alias("known_merchants")).alias("customer"),
        F.struct(merchant.alias("id"), mcc.alias("mcc"), cents(real(MERCHANT, "merchant_avg")).alias("avg_amount")).alias("merchant"),
        F.struct(online.alias("is_online"), (~online & (u("card") < CARD)).alias("card_present"), cents(real(HOME, "home")).alias("km_from_home")).alias("terminal"),
        F.when(u("history") < HISTORY, last).alias("last_transaction"),
    )
