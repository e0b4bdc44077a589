"""JSON in and out: labelled references, evaluation sets, payload text, decision bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.functions.quantize import codes
from vecscore.schema import EVALUATION, FRAUD_LABEL, LABELLED, PAYLOAD, Normalisation, Risk


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, vector, is_fraud) of a JSON array of {vector, label}; gzip by suffix. Order of the file gives the ids.

    One gzipped array can't be split: convert it once with save_index() or to Parquet.
    """
    rows = spark.read.schema(LABELLED).option("multiLine", True).json(path)
    return rows.select(F.monotonically_increasing_id().alias("ref_id"), "vector", (F.coalesce(F.col("label"), F.lit("")) == FRAUD_LABEL).alias("is_fraud"))


def quantized(references: DataFrame) -> DataFrame:
    """(ref_id, codes, is_fraud)."""
    return references.select("ref_id", codes(F.col("vector")).alias("codes"), "is_fraud")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of a JSON array."""
    return spark.read.schema(PAYLOAD).option("multiLine", True).json(path)


def read_evaluation(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Payload columns and expected_approved of {entries: [{request, expected_approved}]}; one object per line and split among tasks unless multi_line."""
    rows = spark.read.schema(EVALUATION).option("multiLine", multi_line).json(path).select(F.explode("entries").alias("e"))
    return rows.select("e.request.*", "e.expected_approved")


def read_normalisation(spark: SparkSession, path: str) -> Normalisation:
    """Normalisation constants from a JSON object; keys that it lacks keep their defaults, unknown ones are ignored."""
    names = list(Normalisation.__dataclass_fields__)
    row = spark.read.schema(", ".join(f"{x} double" for x in names)).option("multiLine", True).json(path).first()
    return Normalisation(**{x: row[x] for x in names if row is not None and row[x] is not None})


def read_risk(spark: SparkSession, path: str, default: float = Risk().default) -> Risk:
    """Risk by merchant category from a JSON object of category to risk."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, double>").alias("m")).first()
    return Risk(default, {k: v for k, v in ((row["m"] or {}) if row is not None else {}).items() if v is not None})


def parse_payload(text: Column) -> Column:
    """A payload from JSON text; what can't be read is null."""
    return F.from_json(text, PAYLOAD, {"mode": "PERMISSIVE"})


def decision_body(approved: Column, score: Column) -> Column:
    """{"approved":...,"fraud_score":...}"""
    return F.to_json(F.struct(approved.alias("approved"), score.alias("fraud_score")))
