import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from vecscore.llm import ann, graph, ngram_join, warc


# --- n-gram join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [shingles(text) for _, text in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (n := len(sets[i] & sets[j])) and 100 * n >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return collections.Counter((key, len(sets[i]), least.get(root(i))) for i, (key, _) in enumerate(rows))


def near_copies(n, seed):
    """Chains of edited copies, exact copies, a shared passage, short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage, bases = [word() for _ in range(60)], [[word() for _ in range(r.choice([6, 40, 120]))] for _ in range(8)]
    out = []
    for i in range(n):
        kind = r.random()
        w = list(r.choice(bases)) if kind < 0.6 else [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 4) if kind < 0.6 else 0):
            w[r.randrange(len(w))] = word()
        if kind > 0.8:
            w[:0] = passage
        text = r.choice([" ", "\n", "\t "]).join(w)
        out.append((i * 7 % 1001, text.upper() if r.random() < 0.1 else text))
    return out


@pytest.mark.parametrize("bundle", [500, 7])
def test_components_equal_brute_force(spark, monkeypatch, bundle):
    monkeypatch.setattr(ngram_join, "BUNDLE", bundle)
    rows = near_copies(400, 4) + [(2000, None), (2001, ""), (2002, " \n"), (None, "null id text of some words"), (2003, "a b"), (2004, "A  b"), (2005, "a b c d e"), (2005, "a b c d e"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS c", "'y' AS s", "1 AS component", "2 AS bundle", "3 AS id", "4 AS n")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(df.repartition(3)).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("bundle", [500, 7])
def test_every_link_is_counted(spark, monkeypatch, bundle):
    """n_links counts all linked documents, also those that other links connect already."""
    monkeypatch.setattr(ngram_join, "BUNDLE", bundle)
    rows = near_copies(300, 9) + [(2000, None), (2003, "a b"), (2004, "A  b"), (2005, "a b c d e")]
    sets = [shingles(text) for _, text in rows]
    linked = lambda a, b: (n := len(a & b)) and 100 * n >= 80 * len(a | b)
    want = collections.Counter((key, sum(1 for j, other in enumerate(sets) if j != i and linked(sets[i], other))) for i, (key, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.join_components(df.repartition(3)).collect()
    assert max(n for _, n in want) > 3 and collections.Counter((r["doc_id"], r["n_links"]) for r in got) == want
    alone = ngram_join.join_components(df, counted=False)
    assert "n_links" not in alone.columns
    assert collections.Counter(map(tuple, alone.collect())) == brute_components(rows)


def test_a_group_of_near_copies_meets_in_large_parts(spark, monkeypatch):
    """Near copies whose first minhashes differ do not ask each other's small bundles one by one."""
    r, word = random.Random(5), lambda r: "".join(r.choice("abcdefgh") for _ in range(6))
    base, rows = [word(r) for _ in range(120)], []
    for i in range(300):
        w = list(base)
        w[r.randrange(len(w))] = word(r)
        rows.append((i, " ".join(w)))
    asked, stage = [], ngram_join.stage

    def counted(df):
        out = stage(df)
        asked.extend([out.count()] if out.columns == ["c", "bundle"] else [])
        return out

    monkeypatch.setattr(ngram_join, "stage", counted)
    monkeypatch.setattr(ngram_join, "BUNDLE", 100)
    sets = [shingles(text) for _, text in rows]
    linked = lambda a, b: 100 * (n := len(a & b)) >= 80 * len(a | b) and n > 0
    want = {(i, sum(linked(a, b) for b in sets) - 1) for i, a in enumerate(sets)}
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {(x["doc_id"], x["n_links"]) for x in got} == want and {x["component_id"] for x in got} == {0}
    assert sum(n for _, n in want) > 60_000 and sum(asked) < 300


def test_many_bundles_are_one_group_of_rows(spark):
    """Small bundles share a task's call, and no link is looked for across bundles."""
    table = ngram_join.Frequencies(20, np.full(1 << 18, 255, np.uint8))
    s = [x.tobytes() for x in ngram_join.shingle_sets(["a b c d e f g", "a b c d e f g", "h i j k l m n"])]
    rows = pd.DataFrame({"bundle": [5, 6, 5, 6, 6], "c": [1, 2, 3, 4, 9], "s": [s[0], s[0], s[1], s[1], s[2]]})
    assert set(ngram_join.bundle_links(rows, table).itertuples(index=False, name=None)) == {(3, 1), (4, 2)}
    members = rows.assign(chunk=0, comp=rows["c"])
    asked = pd.DataFrame({"bundle": [5, 7, 6], "chunk": [0, 0, 1], "c": [10, 11, 12], "comp": [10, 11, 12], "s": [s[0]] * 3})
    assert set(ngram_join.cross_links(asked, members, table).itertuples(index=False, name=None)) == {(10, 1), (10, 3)}


def test_frequencies_reach_the_driver_in_parts(spark, monkeypatch):
    """The table is never collected whole: its parts come one file at a time."""
    df = spark.createDataFrame(near_copies(50, 3), "doc_id bigint, text string")
    want = ngram_join.count_tokens(df, 50).packed

    def refuse(self):
        raise AssertionError("collected whole")

    monkeypatch.setattr(type(df), "collect", refuse)
    got = ngram_join.count_tokens(df, 50)
    assert (got.packed == want).all() and got.packed.any()


def test_join_of_nothing_and_of_one_group(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.join_components(df).count() == 0
    same = spark.createDataFrame([(i, "one and the same text for all of them") for i in range(300)], "doc_id bigint, text string")
    got = ngram_join.join_components(same).collect()
    assert {r["component_id"] for r in got} == {0} and {r["n_links"] for r in got} == {299}


def test_keep_one(spark):
    rows = near_copies(120, 8)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in ngram_join.keep_one(df).collect()}
    assert kept == {c for _, _, c in brute_components(rows)}


def test_prefix_size_is_enough():
    for n in range(1, 60):
        for m in range(n, 60):
            least = next(k for k in range(n + 1) if 100 * k >= 80 * (n + m - k) or k == n)
            if 100 * least >= 80 * (n + m - least):
                assert ngram_join.prefix_size(n) + least > n and ngram_join.prefix_size(m) + least > m


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert graph.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("whole", [0, 1_000_000])
def test_components_of_a_small_graph_are_one_staged_step(spark, monkeypatch, whole):
    """Rounds over all tasks are for graphs too large for one; both give the same."""
    r = random.Random(3)
    rows = [(r.randrange(300), r.randrange(300)) for _ in range(150)]
    staged, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df: staged.append(1) or stage(df))
    monkeypatch.setattr(graph, "WHOLE", whole)
    up = {x: x for row in rows for x in row}
    for _ in rows:
        for a, b in rows:
            up[a] = up[b] = min(up[a], up[b])
    got = {x["id"]: x["component"] for x in graph.components(spark.createDataFrame(rows, "a bigint, b bigint").repartition(3)).collect()}
    assert got == up and (len(staged) == 1) == (whole > 0)


# --- nearest neighbours


def vectors(n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 16)) + 2 * r.normal(size=(8, 16))[r.integers(0, 8, n)]
    return x.astype(np.float32)


def gold(ids, x, queries, k):
    x = x.astype(np.float64)
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [ids[i] for i in order]
    return out


def test_recall_against_brute_force(spark):
    x = vectors(2000, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, lambda i: i % 20 == 0, pivots=128, block=500, query_block=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = gold(list(range(2000)), x, range(0, 2000, 20), 20)
    assert got.keys() == want.keys() and {len(v) for v in got.values()} == {20}
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_unusable_vectors_ties_and_copies(spark):
    x = vectors(30, 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[5].tolist()) for i in range(100, 140)] + [(100, x[5].tolist())]
    bad = [(200, None), (220, [0.0] * 16), (240, [float("nan")] + [1.0] * 15), (260, [None] + [1.0] * 15), (280, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (290, [])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS c", "2 AS v", "3 AS id", "4 AS score", "5 AS no", "6 AS bucket")
    got = found(ann.neighbours(df, lambda i: i % 20 == 0))
    ids = list(range(30)) + list(range(100, 140))
    want = gold(ids, np.concatenate([x, np.repeat(x[5:6], 40, 0)]), [0, 20, 100, 120], 20)
    assert got == want
    assert ann.neighbours(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert ann.neighbours(few, lambda i: i % 20 == 0).count() == 2
    assert ann.neighbours(few, lambda i: i < 0).count() == 0


def found(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r["vec_id"])
    return dict(out)


def test_equal_scores_of_different_vectors_go_to_the_smaller_ids(spark):
    r = np.random.default_rng(3)
    tied = [[1.0, 0.0, *r.normal(size=6).tolist()] for _ in range(60)]
    rows = [(0, [1.0] + [0.0] * 7)] + [(1000 - i, v) for i, v in enumerate(tied)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(ann.neighbours(df, lambda i: i == 0, pivots=2, block=20))
    assert got == {0: list(range(941, 961))}


def test_vectors_of_unequal_size_and_repeated_ids(spark):
    rows = [(0, [1.0, 1.0, 1.0]), (1, [2.0]), (2, [0.5, 3.0]), (3, [1.0, 1.0, -5.0]), (4, [9.0, 0.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.neighbours(df, lambda i: i == 0, k=3, target=1.0).orderBy("rank").collect()]
    assert got == [(4, 9.0), (2, 3.5), (1, 2.0)]


def test_footrule_sums_equal_the_definition():
    r = np.random.default_rng(4)
    near = np.array([r.permutation(20)[:6] for _ in range(50)], np.int16)
    files = ann.Files(near, r.normal(size=(50, 3)), 20, 2)
    own = r.permutation(20)[:9].astype(np.int16)
    place = lambda p, x: list(p[:6]).index(x) if x in p[:6] else 6
    distance = [sum(abs(place(v, x) - place(own, x)) for x in range(20)) for v in near]
    assert (2 * files.footrule(own) == 42 - np.array(distance)).all()


def test_recall_on_the_whole_table(spark):
    """Every query of the table against brute force, with the parameters of op2_ann."""
    from vecscore.llm import registry

    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    got, want = found(registry.op2_ann(spark, sf_dir)), gold(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


# --- WARC


def test_round_trip_with_records_inside_payloads(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "x" * 1500
    rows = [(1, "http://a/", inner * 3), (2, "http://b/", "before" + inner + "WARC/1.1\r\n"), (3, None, None), (4, "u\r\nContent-Length: 9", ""), (5, "http://c/", big), (6, "http://d/", big), (7, "http://e/", big), (8, "http://f/", "small"), (9, "http://g/", "small"), (10, "é", "é漢🙂\r\n\r\n" * 400), (None, "n", "none"), (None, "n", big), (12, "r", "rep" * 500), (12, "r", "rep" * 500)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS payload", "2 AS keeper", "3 AS value")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    keep = {big: 7, "rep" * 500: 12, "é漢🙂\r\n\r\n" * 400: 10}
    want = collections.Counter()
    for i, _, p in rows:
        data = (p or "").encode()
        k = keep.get(p)
        refers = k if k is not None and k != i else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_small_splits_and_broken_archives(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"WARC/1.1\r\nContent-Length: {i}\r\n\r\n" * (i % 5) + f"page {i} " * i) for i in range(80)], "page_id bigint, url string, html string")
    warc.write_warc(warc.plan_records(df.coalesce(1)), f"file://{tmp_path}/w")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = {r["page_id"]: r["payload_digest"] for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {r["page_id"]: hashlib.sha1(r["html"].encode()).hexdigest() for r in df.collect()}
    file = next((tmp_path / "w").glob("part-*"))
    data = file.read_bytes()
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "part-0").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="break off"):
        warc.read_warc(spark, f"file://{tmp_path}/v").collect()


def test_pointer_jumping():
    assert warc.reachable(np.array([2, 3, 4, -1, -1])).tolist() == [True, False, True, False, True]
    n = 1000
    assert warc.reachable(np.r_[np.arange(1, n), -1]).all()
