"""The driver's tables in the shape of the engine's inputs.

embeddings: components are mapped from [-1, 1] to [0, 1]; labels below 3 count as fraud.
events: become transactions. Averages, counts, known merchants and the last transaction of a payload
are computed from the event history; events of type error count as fraud. Features are the
engine's own, taken from the payload's JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecscore.functions.features import vectorize
from vecscore.functions.quantize import codes, signature
from vecscore.schema import FRAUD_LABEL
from vecscore.sources.json import parse_payload
from vecscore.sources.store import drop_staged, settle, staged

# The merchant category that an event type stands for; others have one without a risk of its own.
MCC = {"click": "5411", "view": "5812", "purchase": "5944", "signup": "7801"}
OTHER_MCC = "9999"
DAY_US = 86_400_000_000
#: Rows of a table of sums that is broadcast at most.
FEW_SUMS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, is_fraud, codes, vector) of embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    vector = F.transform("embedding", lambda x: (x.cast("double") + 1) / 2)
    return rows.select(F.col("vec_id").alias("ref_id"), (F.col("label") < 3).alias("is_fraud"), codes(vector).alias("codes"), vector.alias("vector"))


def as_queries(points: DataFrame) -> DataFrame:
    return points.select(F.col("ref_id").alias("qid"), "codes")


def event_micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def mcc(kind: Column) -> Column:
    table_ = F.create_map(*[F.lit(x) for pair in MCC.items() for x in pair])
    return F.coalesce(F.element_at(table_, kind), F.lit(OTHER_MCC))


def event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type, us, ac, k, seen, last, n24, average, k_average): events with whole cents and what was before.

    Events without user or merchant are a group too. History is looked up per user and day (each
    day with the one before it), so a user with very many events is spread over the days; what lies
    further back comes from one row per user and day. Sums are aggregated before they are joined.

    Each lookup is a staged step, and what the one before wrote is deleted: in one job the shuffles of
    all lookups would be on disk together.
    """
    b = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", event_micros("ts").alias("us"), F.round(F.col("value") * 100).cast("bigint").alias("ac"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    ).withColumn("day", F.expr("us div 86400000000"))
    two_days = b.withColumn("bucket", F.explode(F.array(F.col("day"), F.col("day") + 1)))
    # The day after needs to know of an event only when it was.
    two_days = two_days.withColumns({x: F.when(F.col("bucket") == F.col("day"), F.col(x)) for x in ("event_type", "ac", "k")})
    w = Window.partitionBy("user_id", "bucket")
    near = two_days.withColumn("near", F.lag("us").over(w.orderBy("us", "event_id"))).withColumn("n24", F.count(F.lit(1)).over(w.orderBy("us").rangeBetween(-DAY_US, 0)))
    near = staged(near.filter("bucket = day").drop("bucket"))
    days = b.groupBy("user_id", "day").agg(F.max("us").alias("upto"))
    days = days.select(F.col("user_id").alias("du"), F.col("day").alias("dd"), F.lag("upto").over(Window.partitionBy("user_id").orderBy("day")).alias("before"))
    first = b.groupBy(F.col("user_id").alias("fu"), F.col("k").alias("fk")).agg(F.min(F.struct("us", "event_id")).alias("first"))
    users = staged(b.groupBy(F.col("user_id").alias("u")).agg((F.sum("ac") / F.count(F.lit(1)) / 100).alias("average")))
    merchants = staged(b.groupBy(F.col("k").alias("m")).agg((F.sum("ac") / F.count(F.lit(1)) / 100).alias("k_average")))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    few = lambda sums: F.broadcast(sums) if sums.count() <= FEW_SUMS else sums
    names = ["event_id", "user_id", "event_type", "us", "ac", "k"]
    seen = F.struct("us", "event_id") > F.col("first")
    known = staged(near.join(first, same("user_id", "fu") & same("k", "fk")).select(*names, "day", "near", "n24", seen.alias("seen")))
    drop_staged(near)
    settle(spark, now=True)
    rows = staged(known.join(days, same("user_id", "du") & same("day", "dd")).select(*names, "seen", F.coalesce("near", "before").alias("last"), "n24"))
    drop_staged(known)
    settle(spark, now=True)
    rows = rows.join(few(users), same("user_id", "u")).join(few(merchants), same("k", "m"))
    return rows.select(*names, "seen", "last", "n24", "average", "k_average")


def event_payloads(spark: SparkSession, sf_dir: str, cut: bool = True) -> DataFrame:
    """(qid, event_type, value): events as JSON text of a payload; with `cut`, those of type error are cut short, so that they can't be read."""
    b = event_base(spark, sf_dir)
    iso = lambda us: F.date_format(F.expr(f"timestampadd(MICROSECOND, {us}, timestamp_ntz'1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    merchant = F.concat(F.lit("M"), F.coalesce(F.col("k").cast("string"), F.lit("")))
    kind, real = F.col("event_type"), lambda m: (F.col("event_id") * m % 1000).cast("double")
    body = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.struct((F.col("ac") / 100.0).alias("amount"), (F.col("event_id") % 12 + 1).cast("int").alias("installments"), iso("us").alias("requested_at")).alias("transaction"),
        F.struct(F.col("average").alias("avg_amount"), F.col("n24").cast("int").alias("tx_count_24h"), F.when(F.col("seen"), F.array(merchant)).otherwise(F.array().cast("array<string>")).alias("known_merchants")).alias("customer"),
        F.struct(merchant.alias("id"), mcc(kind).alias("mcc"), F.col("k_average").alias("avg_amount")).alias("merchant"),
        F.struct(kind.isin("click", "view").alias("is_online"), (kind == "purchase").alias("card_present"), real(7919).alias("km_from_home")).alias("terminal"),
        F.when(F.col("last").isNotNull(), F.struct(iso("last").alias("timestamp"), real(31).alias("km_from_current"))).alias("last_transaction"),
    ))
    payloads = b.select(F.col("event_id").alias("qid"), "event_type", body.alias("value"))
    return cut_errors(payloads) if cut else payloads


def cut_errors(payloads: DataFrame) -> DataFrame:
    """event_payloads() with the text of errors cut short."""
    return payloads.withColumn("value", F.when(F.col("event_type") == "error", F.substring("value", 1, 40)).otherwise(F.col("value")))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, is_fraud, vector, codes, sig) of all events, through the payload's text."""
    return features_of(event_payloads(spark, sf_dir, cut=False))


def features_of(payloads: DataFrame) -> DataFrame:
    """event_features() of event_payloads() that are not cut."""
    rows = payloads.select(F.col("qid").alias("event_id"), "event_type", parse_payload(F.col("value")).alias("p")).select("event_id", "event_type", "p.*")
    found = vectorize(rows).select("event_id", "event_type", (F.col("event_type") == "error").alias("is_fraud"), "vector")
    return found.withColumn("codes", codes(F.col("vector"))).withColumn("sig", signature(F.col("vector")))


def event_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, points): every event is scored against all others; the search has to exclude the event itself."""
    rows = event_features(spark, sf_dir)
    return rows.select(F.col("event_id").alias("qid"), "codes"), rows.select(F.col("event_id").alias("ref_id"), "is_fraud", "codes")


def event_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vector, label) of events, as a file of labelled references has them."""
    return event_features(spark, sf_dir).select("vector", F.when(F.col("is_fraud"), FRAUD_LABEL).otherwise("legit").alias("label"))
