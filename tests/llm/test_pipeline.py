import collections
import zlib

import numpy as np
import pytest
from test_join_operators import brute_components, near_copies
from test_text_operators import toxic_rows

import corpus_pipeline
from vecscore.llm import packing
from vecscore.llm.common import stage


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean and toxic texts, texts without letters, near copies and boilerplate lines."""
    folder = tmp_path_factory.mktemp("tables")
    toxic = toxic_rows(400, 5)
    docs = [(i, t + "\nshared footer line", "en", "src0", len(t)) for i, t, _, _ in toxic] + [(5000 + i, t, "en", "src1", len(t)) for i, t in {i: t for i, t in near_copies(80, 6)}.items()]
    docs += [(9000 + i, t, "en", "src2", 3) for i, t in enumerate(["123", "", None, "...!"])]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, _, y in toxic], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", docs, toxic


def test_stages(spark, tables):
    sf_dir, docs, toxic = tables
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = df.columns, {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, df, sf_dir)
        if name != "packing":
            assert out.columns == columns
            out = out.cache()
        seen[name] = (df.collect(), out.collect())
        df = out
    before, after = seen["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} >= {9000, 9001, 9002, 9003}
    assert {r[0] for r in docs if r[0] < 5000} <= {r["doc_id"] for r in after}
    _, after = seen["toxicity"]
    left = {r["doc_id"] for r in after}
    bad, good = {i for i, _, _, y in toxic if y}, {i for i, _, _, y in toxic if not y}
    assert len(bad & left) <= 0.05 * len(bad) and len(good - left) <= 0.02 * len(good)
    _, after = seen["line_dedup"]
    assert all("shared footer" not in r["text"] and r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["ngram_join"]
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before])})
    before, after = seen["packing"]
    want = collections.Counter()
    for r in before:
        ids = np.frombuffer(packing.token_bytes([r["text"]])[0], "<u4")
        for at in range(0, len(ids), 2048):
            want[r["doc_id"], at, zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert want == collections.Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in after)


def test_run_equals_the_stages_one_by_one(spark, tables):
    sf_dir, _, _ = tables
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in corpus_pipeline.STAGES:
        df = stage(function(spark, df, sf_dir))
    pieces = lambda rows: collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    shapes = lambda rows: collections.Counter(tuple(sorted(x)) for x in _sequences(rows))
    a, b = got.collect(), df.collect()
    assert len(a) > 0 and pieces(a) == pieces(b) and shapes(a) == shapes(b) and corpus_pipeline.ORACLE_SQL is None


def _sequences(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r["sequence_id"]].append((r["offset"], r["length"]))
    return out.values()


def test_a_staged_step_collects_the_drivers_garbage(spark, monkeypatch):
    from vecscore.sources import store

    monkeypatch.setattr(store, "_settled", 0.0, raising=False)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    stage(spark.range(10))
    assert full() > before
