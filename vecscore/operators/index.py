"""Building the cell index: k-means, splitting, boxes, districts.

Each round of k-means is one pass over the points: tasks assign their points to broadcast
centroids and hand on one row of sums per cell, which are added up before k rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from vecscore.functions.distance import squared
from vecscore.operators.knn import MAX_CELLS, matrix, whole
from vecscore.sources.store import staged


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point (the lowest among equals) and its squared distance."""
    at, d = np.empty(len(points), np.int64), np.empty(len(points))
    for a in range(0, len(points), 2048):
        p = points[a : a + 2048].astype(np.float64)
        x = (p**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * (p @ centroids.T)
        at[a : a + 2048] = x.argmin(1)
        d[a : a + 2048] = ((p - centroids[at[a : a + 2048]]) ** 2).sum(1)
    return at, d


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """points (ref_id, codes, ...) with columns cell and radius (distance to the own centroid)."""
    if len(centroids) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} centroids are not broadcast")
    points = points.filter(whole()) if len(centroids) else points.limit(0)
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    columns = [c for c in points.columns if c not in ("cell", "radius")]
    at = columns.index("codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = nearest(matrix(batch.column(at)), shared.value) if len(batch) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.sqrt(d))], names=[*columns, "cell", "radius"])

    schema = points.select(columns).schema.add("cell", LongType()).add("radius", DoubleType())
    return points.select(columns).mapInArrow(run, schema)


def cell_sums(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cell, n, sums): one step's sums over the points nearest to each centroid."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    dim = centroids.shape[1] if len(centroids) else 1
    points = points.filter(whole()) if len(centroids) else points.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(shared.value), np.int64), np.zeros((len(shared.value), dim))
        for batch in batches:
            if len(batch):
                p = matrix(batch.column(0))
                cell, _ = nearest(p, shared.value)
                n += np.bincount(cell, minlength=len(n))
                for i in range(dim):
                    sums[:, i] += np.bincount(cell, p[:, i], len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(sums[some].astype(np.int64)), pa.list_(pa.int64()))], names=["cell", "n", "sums"])

    parts = points.select("codes").mapInArrow(run, "cell bigint, n bigint, sums array<bigint>")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))


def kmeans(points: DataFrame, k: int, iterations: int = 20, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from k distinct points of the smallest seeded hashes.

    Stops when no centroid moves. An emptied cell starts anew at another point of that order. With
    fewer than k distinct points there are fewer centroids, none without points.
    """
    h = F.xxhash64(F.lit(seed), "codes")
    spare = points.filter(whole()).select("codes", h.alias("h")).distinct().orderBy("h", "codes").limit(2 * k).collect()
    spare = np.array([r["codes"] for r in spare], np.float64)
    centroids, unused = spare[:k], k
    for _ in range(iterations if len(spare) else 0):
        new = centroids.copy()
        filled = np.zeros(len(centroids), bool)
        for r in cell_sums(points, centroids).collect():  # k rows
            new[r["cell"]] = np.array(r["sums"], np.float64) / r["n"]
            filled[r["cell"]] = True
        for i in np.flatnonzero(~filled):
            if unused < len(spare):
                new[i], unused = spare[unused], unused + 1
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids


def _own_cell(rows: pa.RecordBatch, first: np.ndarray, subs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, nearest sub-centroid) of a batch (cell, codes), cell by cell; cell i's own are subs[first[i] : first[i + 1]]."""
    cell, p = rows.column(0).to_numpy(), matrix(rows.column(1))
    order = np.argsort(cell, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        a, b = first[cell[own[0]]], first[cell[own[0]] + 1]
        yield p[own], a + nearest(p[own], subs[a:b])[0]


def _sub_sums(rows: DataFrame, first: np.ndarray, subs: np.ndarray) -> pa.Table:
    """(sub, n, sums): cell_sums() of (cell, codes) where each point meets only the sub-centroids of its cell."""
    shared = rows.sparkSession.sparkContext.broadcast((first, subs))
    dim = subs.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, subs = shared.value
        n, sums = np.zeros(len(subs), np.int64), np.zeros((len(subs), dim))
        for batch in batches:
            if len(batch):
                for p, at in _own_cell(batch, first, subs):
                    some, back = np.unique(at, return_inverse=True)
                    n[some] += np.bincount(back)
                    for i in range(dim):
                        sums[some, i] += np.bincount(back, p[:, i])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(sums[some].astype(np.int64)), pa.list_(pa.int64()))], names=["sub", "n", "sums"])

    parts = rows.mapInArrow(run, "sub bigint, n bigint, sums array<bigint>")
    return parts.groupBy("sub").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums")).toArrow()


def _seeds_of_cells(rows: DataFrame, wanted: dict[int, int], seed: int) -> dict[int, np.ndarray]:
    """For each cell, `wanted` of all its distinct points: those of the smallest seeded hashes; all if there are fewer.

    Only points under a hash that leaves a few more than wanted reach the driver, so no task sorts a cell.
    """
    spark = rows.sparkSession
    distinct = staged(rows.select("cell", "codes", (F.xxhash64(F.lit(seed), "codes") / F.lit(2.0**64) + 0.5).alias("u")).distinct())
    sizes = {r["cell"]: r["n"] for r in distinct.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {c: min(k, sizes[c]) for c, k in wanted.items()}
    slack, short, found = 6.0, dict(wanted), {}
    while short:
        # With k expected, k + 6 * sqrt(k) + 40 are hardly ever fewer than k; if they are, it is tried again with more.
        below = spark.createDataFrame([(c, float(min(2.0, (k + slack * k**0.5 + 40) / sizes[c]))) for c, k in short.items()], "cell bigint, upto double")
        got = distinct.join(F.broadcast(below), "cell").filter(F.col("u") < F.col("upto")).select("cell", "u", "codes").toArrow()
        cell, u, p = got["cell"].to_numpy(), got["u"].to_numpy(), matrix(got["codes"]).astype(np.float64)
        order = np.lexsort((*p.T[::-1], u, cell))
        for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            if len(own) >= wanted[c := int(cell[own[0]])]:
                found[c] = p[own[: wanted[c]]]
        short, slack = {c: k for c, k in wanted.items() if c not in found}, slack * 4
    return found


def split_large(points: DataFrame, centroids: np.ndarray, cap: int, iterations: int = 10, seed: int = 1) -> np.ndarray:
    """Centroids with those of cells above `cap` points replaced by ceil(n / (cap / 2)) of their own.

    Lloyd's rounds over all points of all such cells at once, one pass per round, from distinct
    points of the whole cell; a cell with fewer distinct points gets one centroid for each. One
    level only. A cap that would make more than MAX_CELLS cells is raised: cells then hold more
    points, which a search deals over several tasks.
    """
    placed = assign(points, centroids)
    if len(centroids) > MAX_CELLS // 4:
        raise ValueError(f"more than {MAX_CELLS // 4} centroids to begin with")
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).collect()}
    if not sizes:
        return centroids
    # ceil(n / (cap / 2)) over all cells is at most 2 n / cap and one for each.
    cap = max(cap, 2 * -(-sum(sizes.values()) // (MAX_CELLS - 2 * len(centroids))))
    wanted = {c: -(-n // max(1, cap // 2)) for c, n in sizes.items()}
    rows = staged(placed.filter(F.col("cell").isin(list(sizes))).select("cell", "codes"))
    starts = _seeds_of_cells(rows, wanted, seed)
    first = np.r_[0, np.cumsum([len(starts.get(i, ())) for i in range(len(centroids))])]
    subs = np.concatenate([starts[c] for c in sorted(starts)])
    for _ in range(iterations):
        step = _sub_sums(rows, first, subs)
        new, at = subs.copy(), step["sub"].to_numpy()
        new[at] = matrix(step["sums"]) / step["n"].to_numpy()[:, None]
        if np.array_equal(new, subs):
            break
        subs = new
    kept = [c for i, c in enumerate(centroids) if i not in sizes]
    return np.array([*kept, *subs])


def districts_of(centroids: np.ndarray, k: int, iterations: int = 25) -> np.ndarray:
    """A district for each cell, by k-means over the centroids."""
    k = min(k, len(centroids))
    if not k:
        return np.zeros(0, np.int64)
    c = centroids[np.random.default_rng(1).permutation(len(centroids))[:k]]
    for _ in range(iterations):
        at, _ = nearest(centroids, c)
        for i in range(k):
            if (at == i).any():
                c[i] = centroids[at == i].mean(0)
    return nearest(centroids, c)[0]


def describe(placed: DataFrame, centroids: np.ndarray, districts: np.ndarray | None = None) -> DataFrame:
    """(cell, district, n, first, centroid, lo, hi): counts, offsets in cell order, centroids and boxes of non-empty cells."""
    dim = centroids.shape[1] if len(centroids) else 1
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.col("codes")[i]) for i in range(dim)]).alias("lo"), F.array(*[F.max(F.col("codes")[i]) for i in range(dim)]).alias("hi"))
    districts = districts if districts is not None else np.zeros(len(centroids), np.int64)
    middle = placed.sparkSession.createDataFrame([(i, int(d), c.tolist()) for i, (d, c) in enumerate(zip(districts, centroids, strict=True))], "cell bigint, district bigint, centroid array<double>")
    rows = boxes.join(middle, "cell")
    # One row per cell, so a single ordered window is of bounded size.
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("cell", "district", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "centroid", "lo", "hi")


def _width(rows: DataFrame, column: str) -> int:
    """Length of the vectors of a column; 1 if there are none."""
    return rows.agg(F.max(F.size(column))).first()[0] or 1


def district_boxes(cells: DataFrame) -> DataFrame:
    """(district, cells, lo, hi): union of the boxes of each district's cells."""
    dim = _width(cells, "lo")
    return cells.groupBy("district").agg(F.count(F.lit(1)).alias("cells"), F.array(*[F.min(F.col("lo")[i]) for i in range(dim)]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in range(dim)]).alias("hi"))


def build(points: DataFrame, k: int = 4096, iterations: int = 20, districts: int = 64, cap: int = 1024, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(points with cell and radius, cells) of an index; k is at most the number of distinct points.

    Points are staged once, as every round reads them. Those whose codes are null or hold a null
    are left out; without points there are no cells.
    """
    points = staged(points.filter(whole()))
    centroids = split_large(points, kmeans(points, k, iterations, seed), cap)
    placed = staged(assign(points, centroids))
    return placed, staged(describe(placed, centroids, districts_of(centroids, districts)))


def fixed_centroids(points: DataFrame, k: int) -> np.ndarray:
    """The codes of the k points of lowest id: centroids that any engine can reproduce."""
    return np.array([r["codes"] for r in points.filter(whole()).orderBy("ref_id").limit(k).select("codes").collect()], np.float64)


def widest_dimension(points: DataFrame, by: str) -> DataFrame:
    """(by, dim, width): the dimension of largest range of each group, the lowest among equals."""
    dim = _width(points, "codes")
    ranges = points.groupBy(by).agg(*[(F.max(F.col("codes")[i]) - F.min(F.col("codes")[i])).alias(f"r{i}") for i in range(dim)])
    best = F.array_max(F.array(*[F.struct(F.col(f"r{i}").alias("width"), F.lit(-i).alias("i")) for i in range(dim)]))
    return ranges.select(by, (-best["i"]).cast("bigint").alias("dim"), best["width"].cast("bigint").alias("width"))


def vantage_median(points: DataFrame, by: str) -> DataFrame:
    """(by, vantage, n, median): each group's point of lowest id, and the lower median of squared distances to it."""
    first = points.groupBy(by).agg(F.min_by("codes", "ref_id").alias("v"), F.min("ref_id").alias("vantage"))
    d = points.join(first, by).select(by, "vantage", squared(F.col("codes"), F.col("v")).alias("d2"))
    counts = d.groupBy(by, "vantage", "d2").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(by)
    run = counts.withColumn("upto", F.sum("m").over(w.orderBy("d2"))).withColumn("n", F.sum("m").over(w))
    return run.filter("upto >= (n + 1) div 2").groupBy(by, "vantage", "n").agg(F.min("d2").alias("median"))
