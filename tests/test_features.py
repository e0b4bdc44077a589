import json

import pytest
from pyspark.sql import functions as F

from vecscore.functions.features import vectorize
from vecscore.functions.quantize import code, codes, signature, signature_bound
from vecscore.sources.json import decision_body, parse_payload

BASE = {
    "id": "tx-1329056812",
    "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]},
    "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23},
    "last_transaction": None,
}


def changed(**parts):
    return {k: ({**v, **parts.get(k, {})} if isinstance(v, dict) else parts.get(k, v)) for k, v in BASE.items()}


CASES = {
    "spec": BASE,
    "large": changed(transaction={"amount": 12500.0}),
    "mcc": changed(merchant={"mcc": "9999"}),
    "risky": changed(merchant={"mcc": "7995"}),
    "unknown": changed(merchant={"id": "X"}),
    "history": changed(last_transaction={"timestamp": "2026-03-11T13:20:53Z", "km_from_current": 18.86}),
    "future": changed(last_transaction={"timestamp": "2026-03-12T13:20:53Z", "km_from_current": 1.0}),
    "zero": changed(customer={"avg_amount": 0.0}),
    "zeros": changed(customer={"avg_amount": 0.0}, transaction={"amount": 0.0}),
    "bad_time": changed(transaction={"requested_at": "2026-13-41T99:00:00Z"}),
    "missing": changed(terminal={"km_from_home": None}),
    "integers": changed(transaction={"amount": 41}),
}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(k, json.dumps({**v, "unknown key": [1]})) for k, v in CASES.items()] + [("broken", '{"id": "x", "transaction": {')]
    df = spark.createDataFrame(rows, "name string, value string").select("name", parse_payload(F.col("value")).alias("p")).select("name", "p.*")
    return {r["name"]: r["vector"] for r in vectorize(df).select("name", "vector").collect()}


def test_spec_vector(vectors):
    expected = [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006]
    assert vectors["spec"] == pytest.approx(expected, abs=1e-3)
    assert vectors["integers"][0] == pytest.approx(0.0041)


def test_single_dimensions(vectors):
    assert vectors["large"][0] == 1.0
    assert vectors["mcc"][12] == 0.5 and vectors["risky"][12] == 0.85
    assert vectors["unknown"][11] == 1.0
    assert vectors["history"][5] == pytest.approx(325 / 1440) and vectors["history"][6] == pytest.approx(0.01886)
    assert vectors["future"][5] == 0.0
    assert vectors["zero"][2] == 1.0 and vectors["zeros"][2] == 0.0


def test_unreadable_rows_have_no_vector(vectors):
    assert vectors["bad_time"] is None and vectors["missing"] is None and vectors["broken"] is None


def test_codes(spark):
    values = [-1.0, -0.5, 0.0, 0.49999999999999994 / 16000, 0.5 / 16000, 1.5, float("nan"), 0.35]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(code(F.col("x"))).collect()
    assert [r[0] for r in got] == [-16000, 0, 0, 0, 1, 16000, 0, 5600]


def test_signature_bound_is_admissible(spark):
    rows = spark.createDataFrame([([0.0] * 5 + [-1.0, -1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0],), ([0.0] * 5 + [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0],)], "v array<double>")
    rows = rows.select(codes(F.col("v")).alias("c"), signature(F.col("v")).alias("s"))
    a, b = rows.collect()
    bound = rows.limit(1).select(signature_bound(F.lit(a["s"]), F.lit(b["s"]))).first()[0]
    assert bound == 4 * 16000**2 <= sum((x - y) ** 2 for x, y in zip(a["c"], b["c"]))


def test_body(spark):
    assert spark.range(1).select(decision_body(F.lit(True), F.lit(0.0))).first()[0] == '{"approved":true,"fraud_score":0.0}'


def test_timestamps_are_read_once_a_row(spark):
    from vecscore.plans import adapters

    payloads = adapters.event_payloads(spark, "/root/testdata/sf0.001", cut=False)
    plan = adapters.features_of(payloads)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("RLIKE") <= 2
