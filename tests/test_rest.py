import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_features import BASE, changed
from vecscore import registry
from vecscore.operators import metrics, sampling
from vecscore.sources import json as sources
from vecscore.sources import synth
from vecscore.streaming.score import score_stream, score_text


def test_references_from_gzipped_json(spark, tmp_path):
    rows = [{"vector": [0.5] * 14, "label": "fraud", "more": 1}, {"vector": [-1.0] * 14, "label": "legit"}, {"vector": [0.0] * 14, "label": "other"}]
    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        json.dump(rows, f)
    got = sources.quantized(sources.read_references(spark, f"file://{tmp_path}/refs.json.gz")).orderBy("ref_id").collect()
    assert [r["is_fraud"] for r in got] == [True, False, False]
    assert got[0]["codes"] == [8000] * 14 and got[1]["codes"] == [-16000] * 14


def test_evaluation_file(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"entries": [{"request": BASE, "expected_approved": True}, {"request": BASE, "expected_approved": False}]}))
    got = sources.read_evaluation(spark, f"file://{tmp_path}/e.json").collect()
    assert [r["expected_approved"] for r in got] == [True, False] and got[0]["merchant"]["mcc"] == "5411"


@pytest.mark.parametrize("n", [1, 7, 100, 250])
def test_order_statistics(spark, n):
    values = [(i * 37) % n // 2 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x bigint").repartition(3)
    got = metrics.order_statistics(df, "x", [metrics.p99_index(F.col("n")), metrics.percentile_index(F.col("n"), 50.0)]).first()
    s = sorted(values)
    assert (got["n"], got["mean"], got["max"], got["s0"], got["s1"]) == (n, sum(s) // n, s[-1], s[min(n - 1, n * 99 // 100)], s[min(n - 1, n // 2)])


def test_strided_sample(spark):
    got = sampling.strided(spark.range(1003).repartition(5), ["id"], 10).orderBy("id").collect()
    assert [r[0] for r in got] == list(range(0, 1000, 100))
    assert sampling.seeded(spark.range(50), ["id"], 10).count() == 10
    assert sampling.seeded(spark.range(50), ["id"], 100).count() == 50


def test_synthetic_rows_are_in_range_and_repeatable(spark):
    rows = synth.generate(spark, 2000, 0.3)
    assert rows.exceptAll(synth.generate(spark, 2000, 0.3).repartition(7)).count() == 0
    got = {r["profile"]: r for r in rows.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.min("transaction.amount").alias("lo"), F.max("transaction.amount").alias("hi")).collect()}
    assert 1300 < got["legit"]["n"] < 1500 and got["fraud"]["lo"] >= 2000 and got["legit"]["hi"] <= 500
    assert rows.filter("terminal.is_online and terminal.card_present").count() == 0


def test_malformed_text_and_missing_index_take_the_fallback(spark, tmp_path):
    texts = spark.createDataFrame([(0, json.dumps(BASE)), (1, "{broken"), (2, None), (3, json.dumps(changed(transaction={"requested_at": "?"})))], "qid bigint, value string")
    near = lambda q: q.select("qid", F.lit(True).alias("is_fraud")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5))))
    got = {r["qid"]: (r["n_fraud"], r["approved"]) for r in score_text(texts, near).collect()}
    assert got == {0: (5, False), 1: (0, True), 2: (0, True), 3: (0, True)}
    assert {r["body"] for r in score_text(texts, None).collect()} == {'{"approved":true,"fraud_score":0.0}'}


def test_stream_without_index(spark, tmp_path):
    texts = spark.createDataFrame([(json.dumps(BASE),), ("{broken",)], "value string")
    texts.write.text(f"file://{tmp_path}/in")
    seen = []
    score_stream(spark.readStream.text(f"file://{tmp_path}/in"), f"file://{tmp_path}/none", lambda df, i: seen.extend(df.select("approved").collect()), f"file://{tmp_path}/cp").awaitTermination()
    assert len(seen) == 2 and all(r["approved"] for r in seen)


def test_every_oracle_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_sweep_and_gold_cache(spark, tmp_path):
    from vecscore.operators import evaluate

    everyone = spark.range(10).withColumnRenamed("id", "qid")
    found = lambda n: everyone.select("qid", (F.col("qid") < n).alias("is_fraud")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5))))
    path = f"file://{tmp_path}/gold"
    gold = evaluate.gold(everyone, found(4), spark, path)
    assert evaluate.gold(everyone, None, spark, path).count() == gold.count() == 10
    rows = evaluate.sweep(everyone, {"same": found(4), "less": found(2), "more": found(5)}, gold)
    evaluate.write_report(rows, f"file://{tmp_path}/report")
    assert {r["variant"]: (r["fp"], r["fn"], r["e"]) for r in rows.collect()} == {"same": (0, 0, 0), "less": (0, 2, 6), "more": (1, 0, 1)}


def test_constants_from_files(spark, tmp_path):
    from vecscore.functions.features import vectorize
    from vecscore.schema import Normalisation, Risk

    (tmp_path / "n.json").write_text(json.dumps({"max_amount": 100, "max_km": 50.5, "other": "x"}))
    (tmp_path / "r.json").write_text(json.dumps({"5411": 0.9, "1": None}))
    (tmp_path / "p.json").write_text(json.dumps([BASE, changed(merchant={"mcc": "7995"})]))
    norm, risk = sources.read_normalisation(spark, f"file://{tmp_path}/n.json"), sources.read_risk(spark, f"file://{tmp_path}/r.json")
    assert norm == Normalisation(max_amount=100.0, max_km=50.5) and risk == Risk(by_mcc={"5411": 0.9})
    got = [r["vector"] for r in vectorize(sources.read_payloads(spark, f"file://{tmp_path}/p.json"), norm, risk).collect()]
    assert got[0][0] == pytest.approx(0.4112) and got[0][12] == 0.9 and got[1][12] == 0.5


def test_seeded_sample_is_the_same_in_another_engine(spark):
    import hashlib

    got = {r[0] for r in sampling.seeded(spark.range(500).repartition(7), ["id"], 20, seed=3).collect()}
    assert got == set(sorted(range(500), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())[:20])


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from vecscore.sources import store

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        store.new_path(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert store.new_path(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_kmeans_build_over_cells_above_the_cap(spark, tmp_path):
    """Cells of more points than the cap are split, which makes more than k cells: as many as asked for."""
    from vecscore.plans import catalog

    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, i % 10, x) for i, x in enumerate(rng.uniform(-1, 1, (6000, 64)).tolist())], "vec_id bigint, label int, embedding array<float>")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(23)))).selectExpr("vec_id + 6000 * i AS vec_id", "label", "embedding")
    rows.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    row = catalog.q_kmeans_build(spark, f"file://{tmp_path}").first()
    assert (row["points"], row["offsets_fit"], row["bounded"]) == (144_000, True, True)
