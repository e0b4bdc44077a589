"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. It is posted in the inverted files of its
first few; a query looks only into the files of the pivots nearest to it. What it finds there is
ranked by footrule distance: as a pivot that only one of two has costs what its place says, that
distance is a constant less twice the sum over shared pivots of (depth - the later place). The
nearest share by footrule is reranked by inner product.

Files are dealt over buckets, so that a vector or query is sent to a bucket once however many of
its pivots lie there; a bucket of many postings or many queries is split over several tasks by
the hash of either. How many files a query visits is found on the data: the exact neighbours of a
sample of queries say how far down its list of pivots a query has to go to meet the wanted share
of them. Pivots grow with the square root of the table, so a file's length does too.

Equal vectors are one class with its smallest ids, so a vector that many rows share is posted
once. Inner products of vectors of unequal length become distances by one more coordinate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecscore.llm.common import stage

#: Files that a vector is posted in, pivots that footrule distances look at, share of what the files hold that is reranked.
POSTS, DEPTH, SHARE = 4, 32, 0.5
#: Pivots are so many times the square root of the number of classes, but no fewer or more than these.
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 4, 16, 4096
#: The share of the sampled queries' neighbours that the visited files must hold, and the sample's size.
TARGET, SAMPLE = 0.98, 64
#: Postings and queries of one task at most, on average.
BLOCK, QUERY_BLOCK = 16_384, 8_192
SALT = 16


def usable(vector: str):
    """Whether a vector takes part: not null or zero, no null or non-finite component."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a coordinate that gives all of them the same length."""
    rest = longest**2 - (vectors**2).sum(1)
    return np.hstack([vectors, np.sqrt(np.maximum(rest, 0))[:, None]])


def as_queries(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The point of that length nearest to all that have a large inner product with a query."""
    return np.hstack([vectors * (longest / np.linalg.norm(vectors, axis=1, keepdims=True)), np.zeros((len(vectors), 1))])


def permutations(points: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The nearest pivots of each point, nearest first (ties: the lower number)."""
    d = -(points @ pivots.T)
    if depth < len(pivots):
        near = np.argpartition(d, depth - 1, axis=1)[:, :depth]
        near.sort(axis=1)
    else:
        near = np.broadcast_to(np.arange(len(pivots)), d.shape)
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


def inner(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    return np.cumsum(vectors * q, axis=1)[:, -1]


class Files:
    """The inverted files of some vectors: for each pivot, which of them have it among their nearest, and at which place.

    first: those that have it among their first `posts`, which a query visits.
    """

    def __init__(self, nearest: np.ndarray, vectors: np.ndarray, pivots: int, posts: int):
        self.vectors, self.depth = vectors, nearest.shape[1]
        self.short = (vectors / max(np.linalg.norm(vectors, axis=1).max(), 1e-300)).astype(np.float32)
        flat = nearest.ravel()
        order = np.argsort(flat, kind="stable")
        self.bounds = np.searchsorted(flat[order], np.arange(pivots + 1))
        self.who, self.worth = order // self.depth, (self.depth - order % self.depth).astype(np.float64)
        self.first = [own[worth > self.depth - posts] for own, worth in zip(np.split(self.who, self.bounds[1:-1]), np.split(self.worth, self.bounds[1:-1]), strict=True)]

    def footrule(self, own: np.ndarray) -> np.ndarray:
        """Sums over shared pivots of (depth - later place) for all vectors: the more, the nearer."""
        spans = [slice(self.bounds[p], self.bounds[p + 1]) for p in own[: self.depth].tolist()]
        worth = [np.minimum(self.worth[x], self.depth - place) for place, x in enumerate(spans)]
        return np.bincount(np.concatenate([self.who[x] for x in spans]), np.concatenate(worth), len(self.vectors))

    def search(self, q: np.ndarray, own: np.ndarray, visited: np.ndarray, many: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, inner products) of all that may be among the `many` best; equals of the last stay."""
        mark = np.zeros(len(self.vectors), bool)
        for p in visited.tolist():
            mark[self.first[p]] = True
        rows = np.flatnonzero(mark)
        least = max(4 * many, int(np.ceil(share * len(rows))))
        if least < len(rows):
            near = self.footrule(own)[rows]
            rows = rows[near >= np.partition(near, len(rows) - least)[len(rows) - least]]
        if len(rows) > many:
            # In single precision, of vectors of length 1 at most; the margin is far above its rounding.
            s = self.short[rows] @ (q / np.linalg.norm(q)).astype(np.float32)
            rows = rows[s >= np.partition(s, len(s) - many)[len(s) - many] - 1e-5]
        return rows, inner(self.vectors[rows], q)


def best_ids(score: np.ndarray, ids: list[np.ndarray], many: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the `many` first rows of some classes by score, then id."""
    all_ids, all_scores = np.concatenate(ids), np.repeat(score, [len(x) for x in ids])
    order = np.lexsort((all_ids, -all_scores))[:many]
    return all_ids[order], all_scores[order]


def classes_of(vectors: DataFrame, is_query, most: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Staged classes (no, a, b, v, ids, asked) of equal vectors, and the asking rows (query_id, a, b).

    ids: the class's `most` smallest. A class is known by two 64-bit hashes, so two of n different
    vectors would be confused with a probability of about n^2 / 2^129.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("v")).filter(F.col("id").isNotNull() & usable("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    zero = F.lit(0.0).cast(kind[6:-1])
    rows = rows.select("id", F.when(F.size("v") < width, F.concat("v", F.array_repeat(zero, F.lit(width) - F.size("v")))).otherwise(F.col("v")).alias("v"))
    rows = rows.groupBy("id").agg(F.max("v").alias("v")).select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    asking = rows.filter(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "a", "b")
    asked = asking.select("a", "b").distinct().withColumn("asked", F.lit(True))
    least = Window.partitionBy("a", "b").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= most)
    classes = few.groupBy("a", "b").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")).join(asked, ["a", "b"], "left")
    return stage(classes.select(F.monotonically_increasing_id().alias("no"), "a", "b", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))), asking


def indexed(classes: DataFrame, pivots: np.ndarray, longest: float, depth: int) -> DataFrame:
    """Classes with their nearest pivots (near)."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = permutations(lifted(matrix(batch.column(1)).astype(np.float64), longest), shared.value, depth)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.FixedSizeListArray.from_arrays(near.astype(np.int16).ravel(), near.shape[1]).cast(pa.list_(pa.int16()))], names=["no", "v", "ids", "near"])

    return classes.select("no", "v", "ids").mapInArrow(run, f"no bigint, v {classes.schema['v'].dataType.simpleString()}, ids array<bigint>, near array<smallint>")


def visits(index: DataFrame, sample: list, pivots: np.ndarray, longest: float, k: int, posts: int, target: float) -> int:
    """How many pivots of a query's list have to be visited to meet `target` of the sampled queries' exact neighbours.

    sample: (no, v) of query classes. Each task keeps k neighbours for each of them.
    """
    own = np.array([r[1] for r in sample], np.float64)
    order = permutations(as_queries(own, longest), pivots, len(pivots))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(pivots)), order.shape), 1)
    shared = index.sparkSession.sparkContext.broadcast((np.array([r[0] for r in sample]), own, place.astype(np.int16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, queries, place = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in numbers]
        for batch in batches:
            if not len(batch):
                continue
            no, first = batch.column(0).to_numpy(), matrix(batch.column(2))[:, :posts]
            scores = queries @ matrix(batch.column(1)).astype(np.float64).T
            for i, s in enumerate(scores):
                s[no == numbers[i]] = -np.inf
                top = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                need = place[i][first[top]].min(1)
                s, need = np.r_[best[i][0], s[top]], np.r_[best[i][1], need]
                top = np.argsort(-s, kind="stable")[:k]
                best[i] = (s[top], need[top])
        at = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate([s for s, _ in best])), pa.array(np.concatenate([n for _, n in best]), pa.int64())], names=["i", "s", "need"])

    found = index.select("no", "v", "near").mapInArrow(run, "i int, s double, need bigint").filter(F.col("s") > F.lit(float("-inf")))
    first = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "need"))
    needs = sorted(r[0] for r in found.withColumn("r", first).filter(F.col("r") <= k).select("need").collect())  # k for each sampled query
    return needs[max(0, int(np.ceil(target * len(needs))) - 1)] + 1 if needs else len(pivots)


def neighbours(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, depth: int = DEPTH, posts: int = POSTS, share: float = SHARE, target: float = TARGET, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row.

    is_query: a condition over id_col. Ties go to the smaller id; a query's own id is no candidate;
    with fewer candidates there are fewer rows. Unusable vectors (see usable()) and null ids take
    no part. Of rows that repeat an id the greatest vector counts; shorter vectors count as filled
    up with zeros. The pivots are distinct vectors, those of the smallest hashes: `pivots` of them,
    or by default PER_ROOT times the square root of the number of classes, within the bounds above.
    """
    spark = vectors.sparkSession
    classes, asking = classes_of(vectors, is_query, k + 1, id_col, vector_col)
    norm, n, n_asked = classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), F.count(F.lit(1)), F.count_if("asked")).first()
    if not n_asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    longest = float(np.sqrt(norm))
    many = pivots or int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PER_ROOT * n**0.5)))
    points = lifted(np.array([r[0] for r in classes.orderBy("a", "b").limit(many).select("v").collect()], np.float64), longest)
    many, depth, posts = len(points), min(depth, len(points)), min(posts, len(points))
    index = stage(indexed(classes, points, longest, depth))
    sample = classes.filter("asked").orderBy("b", "a").limit(SAMPLE).select("no", "v").collect()
    visited = visits(index, sample, points, longest, k, posts, target)
    buckets = max(1, min(many, -(-n * posts // block)))

    shared = spark.sparkContext.broadcast(points)

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = permutations(as_queries(matrix(batch.column(1)).astype(np.float64), longest), shared.value, max(depth, visited))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(near.astype(np.int16).ravel(), near.shape[1]).cast(pa.list_(pa.int16()))], names=["no", "v", "near"])

    kind = classes.schema["v"].dataType.simpleString()
    queries = stage(classes.filter("asked").select("no", "v").mapInArrow(orders, f"no bigint, v {kind}, near array<smallint>"))
    of = lambda first: F.explode(F.array_distinct(F.transform(F.slice("near", 1, first), lambda p: (p % buckets).cast("int")))).alias("bucket")
    posted, asked = index.select("no", "v", "ids", "near", of(posts)), queries.select("no", "v", "near", of(visited))
    # A row per bucket, MOST_PIVOTS at most.
    shape = posted.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts")).join(asked.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_block)).alias("sides")), "bucket")
    shape = F.broadcast(stage(shape.select("bucket", F.col("parts").cast("int").alias("parts"), F.col("sides").cast("int").alias("sides"))))
    own = lambda m: F.pmod(F.xxhash64("no"), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = asked.join(shape, "bucket").withColumn("side", own("sides")).select("bucket", each("parts").alias("part"), "side", "no", "v", "near")
    right = posted.join(shape, "bucket").withColumn("part", own("parts")).select("bucket", "part", each("sides").alias("side"), "v", "ids", "near")

    def search(asked: pa.Table, entries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(asked) and len(entries):
            bucket = asked["bucket"][0].as_py()
            files = Files(matrix(entries["near"]), matrix(entries["v"]).astype(np.float64), many, posts)
            ids = entries["ids"].combine_chunks()
            flat, bounds = ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
            for no, q, near in zip(asked["no"].to_pylist(), matrix(asked["v"]).astype(np.float64), matrix(asked["near"]), strict=True):
                look = near[:visited]
                rows, s = files.search(q, near, look[look % buckets == bucket], k + 1, share)
                if len(rows):
                    found, scores = best_ids(s, [flat[bounds[r] : bounds[r + 1]] for r in rows.tolist()], k + 1)
                    out.append((np.full(len(found), no), found, scores))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["no", "id", "score"])

    keys = ("bucket", "part", "side")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "no bigint, id bigint, score double").distinct()
    # Per class of queries its k + 1 best rows, the same for all its ids but their own.
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    lists = best.groupBy("no").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id")))).alias("near"))
    lists = lists.join(classes.filter("asked").select("no", "a", "b"), "no").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = asking.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALT)).cast("int")).join(lists, ["a", "b", "salt"])
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return joined.select("query_id", F.posexplode(near).alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
