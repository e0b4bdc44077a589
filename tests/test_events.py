from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecscore.plans import adapters, catalog

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    """The five nearest other events of every event: {qid: [(ref_id, d2, is_fraud), ...]}."""
    ids, c = np.array([r["event_id"] for r in rows]), np.array([r["codes"] for r in rows], np.int64)
    fraud = {r["event_id"]: r["is_fraud"] for r in rows}
    out = {}
    for i, q in enumerate(ids):
        d = ((c - c[i]) ** 2).sum(1)
        out[int(q)] = [(int(ids[j]), int(d[j]), fraud[int(ids[j])]) for j in np.lexsort((ids, d)) if j != i][:5]
    return out


@pytest.mark.parametrize("days", [None, "2024-01-10", "2024-02-10"])
def test_all_events_are_searched_whatever_their_dates(spark, tmp_path, days):
    """Every event is a query and a candidate, on whichever days the events lie."""
    rows = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_id % 3 = 0")
    if days:
        rows = rows.withColumn("ts", F.expr(f"timestamp_ntz'{days} 00:00:00' + make_dt_interval(0, 0, cast(event_id % 997 as int), 0)"))
    rows.write.parquet(f"file://{tmp_path}/events.parquet")
    sf_dir = f"file://{tmp_path}"
    want = brute(adapters.event_features(spark, sf_dir).collect())
    got = {(r["qid"], r["rank"], r["ref_id"], r["d2"]) for r in catalog.q_signature_prune_knn(spark, sf_dir).collect()}
    assert got == {(q, k + 1, ref, d) for q, near in want.items() for k, (ref, d, _) in enumerate(near)}
    votes = {r["qid"]: r["n_fraud"] for r in catalog.q_event_votes(spark, sf_dir).collect()}
    assert votes == {q: sum(f for _, _, f in near) for q, near in want.items()}


def test_fallback_scoring_meets_all_other_events(spark, tmp_path):
    """Scored payloads find neighbours on whichever day all of them lie."""
    rows = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_id % 3 = 0")
    rows.withColumn("ts", F.expr("timestamp_ntz'2024-02-10 00:00:00' + make_dt_interval(0, 0, cast(event_id % 997 as int), 0)")).write.parquet(f"file://{tmp_path}/events.parquet")
    got = {r["n_fraud"]: r["n"] for r in catalog.q_fallback_scoring(spark, f"file://{tmp_path}").collect()}
    assert sum(got.values()) == rows.count() and max(got) > 0


def test_events_without_user_or_merchant_keep_their_row(spark, tmp_path):
    import duckdb

    from vecscore.plans import oracle

    rows = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_id % 5 = 0")
    rows = rows.withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id"))).withColumn("props", F.when(F.col("event_id") % 4 != 0, F.col("props")).otherwise("{}"))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(oracle.sql()["q_features_vector"]).fetchall())
    got = sorted(tuple(r) for r in catalog.q_features_vector(spark, f"file://{tmp_path}").collect())
    assert len(got) == rows.count() and got == want


def test_history_of_a_user_across_days(spark, tmp_path):
    """Gaps of hours, a day and many days between a user's events, and events at the same time: against a plain loop."""
    import datetime

    start = datetime.datetime(2024, 1, 1, 22)
    hours = [0, 1, 1, 3, 24, 25, 49, 49.5, 200, 223.9, 224]
    rows = [(i, start + datetime.timedelta(hours=h), i % 2, "view", 1.0 + i, '{"k": %d}' % (i % 3)) for i, h in enumerate(h for h in hours for _ in range(2))]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"file://{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["n24"], r["last"], r["seen"]) for r in adapters.event_base(spark, f"file://{tmp_path}").collect()}
    epoch = datetime.datetime(1970, 1, 1)
    for i, ts, user, _, _, k in rows:
        own = [r for r in rows if r[2] == user]
        before = [r for r in own if (r[1], r[0]) < (ts, i)]
        day = datetime.timedelta(days=1)
        last = max(((r[1] - epoch) // datetime.timedelta(microseconds=1) for r in before), default=None)
        assert got[i] == (sum(ts - day <= r[1] <= ts for r in own), last, any(r[5] == k for r in before))


@pytest.fixture
def compared(monkeypatch):
    """The pairs that the cells' search compares, added up."""
    from vecscore.operators import knn

    seen, within = [], knn.within_cells

    def counted(queries, points, *args, **more):
        both = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("a")).join(points.groupBy("cell").agg(F.count(F.lit(1)).alias("b")), "cell")
        seen.append(both.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0)
        return within(queries, points, *args, **more)

    monkeypatch.setattr(knn, "within_cells", counted)
    return seen


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Some events thirty times, under other ids and users: (folder, brute-force neighbours, events)."""
    path = tmp_path_factory.mktemp("repeated")
    rows = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_id % 25 = 0")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("event_id", F.expr("event_id + i * 12000")).withColumn("user_id", F.expr("user_id + i * 1500")).drop("i")
    rows.write.parquet(f"file://{path}/events.parquet")
    events = adapters.event_features(spark, f"file://{path}").collect()
    return f"file://{path}", brute(events), events


def test_copies_of_events_are_compared_once_for_votes(spark, repeated, compared):
    sf_dir, want, events = repeated
    votes = {r["qid"]: r["n_fraud"] for r in catalog.q_event_votes(spark, sf_dir).collect()}
    assert votes == {q: sum(f for _, _, f in near) for q, near in want.items()}
    assert sum(compared) * 10 < len(events) ** 2 / 9


def test_copies_of_events_are_compared_once_for_neighbours(spark, repeated, compared):
    sf_dir, want, events = repeated
    got = {(r["qid"], r["rank"], r["ref_id"], r["d2"]) for r in catalog.q_signature_prune_knn(spark, sf_dir).collect()}
    assert got == {(q, k + 1, ref, d) for q, near in want.items() for k, (ref, d, _) in enumerate(near)}
    assert sum(compared) * 10 < len(events) ** 2 / 9


def test_copies_of_events_are_compared_once_for_the_fallback(spark, repeated, compared):
    sf_dir, want, events = repeated
    got = {r["n_fraud"]: r["n"] for r in catalog.q_fallback_scoring(spark, sf_dir).collect()}
    error = {r["event_id"] for r in events if r["is_fraud"]}
    assert got == Counter(0 if q in error else sum(f for _, _, f in near) for q, near in want.items())
    assert sum(compared) * 10 < len(events) ** 2 / 9


def test_payload_files_are_compressed_and_copies_compared_once(spark, repeated, compared):
    sf_dir, want, events = repeated
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("*/part-*.txt*"))
    row = catalog.q_evaluate_payloads(spark, sf_dir).first()
    error, fraud = {r["event_id"] for r in events if r["is_fraud"]}, {q for q, near in want.items() if sum(f for _, _, f in near) >= 3}
    assert (row["n"], row["fp"], row["fn"]) == (len(events), len(fraud - error), len(error - fraud))
    written = set(shared.glob("*/part-*.txt*")) - before
    assert written and all(p.suffix == ".gz" for p in written)
    assert sum(compared) * 10 < len(events) ** 2 / 9


def test_leaves_of_a_tree_prune_within_a_signature(spark, compared):
    """Unlike points of one signature: few leaves are visited, and nothing is lost, ties included."""
    from vecscore.operators import knn

    rng = np.random.default_rng(3)
    c = np.zeros((6000, 14), np.int64)
    c[:, 0], c[:, 7] = rng.integers(0, 400, (2, 6000)) * 40
    rows = [(i, i % 3 == 0, x) for i, x in enumerate(c.tolist())]
    points = spark.createDataFrame(rows, "ref_id bigint, is_fraud boolean, codes array<int>")
    queries = points.filter("ref_id % 10 = 0").select(F.col("ref_id").alias("qid"), "codes")
    key = lambda df: sorted(map(tuple, df.select("qid", "ref_id", "is_fraud", "d2", "rank").collect()))
    assert key(knn.by_signature(queries, points, exclude_self=True)) == key(knn.brute(queries, points, exclude_self=True))
    assert sum(compared) < 600 * 6000 / 2


@pytest.mark.parametrize("few", [0, 100_000])
def test_lookups_of_history_are_steps_of_their_own(spark, monkeypatch, few):
    """The shuffles of one lookup are not on disk together with those of the next: what is left to do has those of large sums alone."""
    want = sorted(map(tuple, adapters.event_base(spark, SMALL).collect()))
    monkeypatch.setattr(adapters, "FEW_SUMS", few, raising=False)
    rows = adapters.event_base(spark, SMALL)
    assert rows._jdf.queryExecution().sparkPlan().toString().count("Scan parquet") == 3
    assert rows._jdf.queryExecution().executedPlan().toString().count("Window") == 0
    assert sorted(map(tuple, rows.collect())) == want and len(want) == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_shuffles_of_finished_steps_leave_the_disk(spark, monkeypatch):
    import time

    from vecscore.sources import store

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in disk.getAllFiles().mkString(" ").split() if "/shuffle_" in x}
    before = shuffles()
    store.staged(spark.range(1000).groupBy(F.col("id") % 7).count())
    made = shuffles() - before
    assert made
    monkeypatch.setattr(store, "_settled", 0.0, raising=False)
    store.staged(spark.range(1))
    end = time.monotonic() + 20
    while made & shuffles() and time.monotonic() < end:
        time.sleep(0.2)
    assert not made & shuffles()
