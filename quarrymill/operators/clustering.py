"""Large-scale clustering: k-means, cluster summaries and BFR over rounds of points.

Points are (id bigint, features array<double>). Distances are computed in numpy on Arrow batches against a
set of clusters whose number is a parameter; sums over points are combined by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymill.plans.shipping import ship
from quarrymill.plans.skew import attach
from quarrymill.plans.storage import discard, materialize

#: Added to a variance, so that a cluster without spread takes only equal points.
FLOOR = 6.95e-300
#: Retained points up to so many are clustered on the driver, more of them by Spark.
DRIVER_POINTS = 10_000
ROUND_FIELDS = "round_id int, nof_cluster_discard int, nof_point_discard long, nof_cluster_compression int, nof_point_compression long, nof_point_retained long"


def _matrix(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


class Summaries:
    """N, SUM and SUMSQ of clusters; centroid and diagonal variance follow from them."""

    def __init__(self, n: np.ndarray, total: np.ndarray, squares: np.ndarray):
        self.n, self.total, self.squares = np.asarray(n, np.int64), np.asarray(total, np.float64), np.asarray(squares, np.float64)

    @staticmethod
    def of(x: np.ndarray, label: np.ndarray, k: int) -> Summaries:
        hot = (label[:, None] == np.arange(k)).astype(np.float64)
        return Summaries(hot.sum(axis=0), hot.T @ x, hot.T @ (x * x))

    def __len__(self) -> int:
        return len(self.n)

    @property
    def centroid(self) -> np.ndarray:
        return self.total / np.maximum(1, self.n)[:, None]

    @property
    def variance(self) -> np.ndarray:
        return np.maximum(0, self.squares / np.maximum(1, self.n)[:, None] - self.centroid**2) + FLOOR

    def mahalanobis(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of points (rows) to clusters (columns)."""
        out = np.empty((len(x), len(self)))
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for j, (c, v) in enumerate(zip(self.centroid, self.variance)):
                out[:, j] = np.where(x == c, 0, (x - c) ** 2 / v).sum(axis=1)
        return out

    def plus(self, other: Summaries) -> Summaries:
        return Summaries(self.n + other.n, self.total + other.total, self.squares + other.squares)

    def joined(self, other: Summaries) -> Summaries:
        if not len(self) or not len(other):
            return other if len(other) else self
        return Summaries(np.concatenate([self.n, other.n]), np.vstack([self.total, other.total]), np.vstack([self.squares, other.squares]))

    def pick(self, at: list[int]) -> Summaries:
        return Summaries(self.n[at], self.total[at], self.squares[at])


def euclidean(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to centers (columns)."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def seeded_order(ids: np.ndarray, seed: int) -> np.ndarray:
    """The order in which points are taken as first centers: by md5 of seed and id, as Spark and SQL have it too."""
    return np.array(sorted(range(len(ids)), key=lambda k: (hashlib.md5(f"{seed}:{ids[k]}".encode()).hexdigest(), ids[k])), np.int64)


def lloyd(x: np.ndarray, order: np.ndarray, k: int, max_iter: int = 100, tol: float = 1e-9) -> np.ndarray:
    """Labels of a k-means in memory; the first k points by `order` begin, emptied clusters take the farthest points."""
    k = min(k, len(x))
    centers = x[order[:k]]
    for _ in range(max_iter):
        d = euclidean(x, centers)
        label, far = d.argmin(axis=1), iter(np.argsort(-d.min(axis=1), kind="stable"))
        new = np.stack([x[label == j].mean(axis=0) if (label == j).any() else x[next(far)] for j in range(k)])
        moved = np.abs(new - centers).max()
        centers = new
        if moved <= tol:
            break
    return euclidean(x, centers).argmin(axis=1)


def steadier_lloyd(x: np.ndarray, ids: np.ndarray, k: int, seed: int, starts: int = 8) -> np.ndarray:
    """The labels of least squared distance to the means from several seeds, the first of equal ones."""
    best = None
    for s in range(seed, seed + starts):
        label = lloyd(x, seeded_order(ids, s), k)
        means = np.stack([x[label == j].mean(axis=0) for j in np.unique(label)])
        cost = euclidean(x, means).min(axis=1).sum()
        if best is None or cost < best[0] * (1 - 1e-12):
            best = cost, label
    return best[1]


def summarize(points: DataFrame, by: str) -> DataFrame:
    """(by, pos, n, total, squares): the summary of each group, one row for each dimension, by partial sums."""
    one = points.select(by, F.posexplode("features").alias("pos", "x"))
    return one.groupBy(by, "pos").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def _collected(sums: DataFrame, by: str, k: int) -> Summaries | None:
    """k summaries from k * dim rows."""
    rows = sums.collect()
    if not rows:
        return None
    dim = max(r["pos"] for r in rows) + 1
    n, total, squares = np.zeros(k, np.int64), np.zeros((k, dim)), np.zeros((k, dim))
    for r in rows:
        n[r[by]], total[r[by], r["pos"]], squares[r[by], r["pos"]] = r["n"], r["total"], r["squares"]
    return Summaries(n, total, squares)


def group_summaries(points: DataFrame, by: str) -> tuple[list, Summaries]:
    """The groups in ascending order and their summaries; for a number of groups that the driver can hold."""
    keys = [r[0] for r in points.select(by).dropna().distinct().orderBy(by).collect()]
    number = F.create_map(*[F.lit(v) for i, key in enumerate(keys) for v in (key, i)])[F.col(by)]
    return keys, _collected(summarize(points.withColumn("_c", number), "_c"), "_c", len(keys))


def nearest(points: DataFrame, clusters: Summaries, metric: str) -> DataFrame:
    """points with `cluster` (number of the nearest, the first of equal ones) and `distance` (squared)."""
    ship(points.sparkSession)
    measure = clusters.mahalanobis if metric == "mahalanobis" else lambda x: euclidean(x, clusters.centroid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            d = measure(_matrix(b.column("features")))
            best = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(d)), best])], [*b.schema.names, "cluster", "distance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + ", cluster int, distance double"
    return points.mapInArrow(run, schema)


def kmeans(points: DataFrame, k: int, seed: int = 0, max_iter: int = 100, tol: float = 1e-9) -> DataFrame:
    """(id, cluster): Lloyd's iterations, each one scan of the points and sums of k * dim numbers.

    Begins with the k points of least md5 of seed and id; emptied clusters take the points farthest from their own.
    """
    points = materialize(points.select("id", "features"), "kmeans-points")
    first = points.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(k).collect()
    centers = np.array([r["features"] for r in first], np.float64)
    for _ in range(max_iter if len(centers) else 0):
        near = nearest(points, Summaries(np.ones(len(centers)), centers, centers), "euclidean")
        sums = _collected(summarize(near, "cluster"), "cluster", len(centers))
        new = sums.centroid
        if (empty := np.flatnonzero(sums.n == 0)).size:
            far = near.orderBy(F.desc("distance"), "id").limit(len(empty)).collect()
            for j, r in zip(empty, far):
                new[j] = r["features"]
        moved = np.abs(new - centers).max()
        centers = new
        if moved <= tol:
            break
    if not len(centers):
        out = points.select("id", F.lit(0).alias("cluster"))
    else:
        out = nearest(points, Summaries(np.ones(len(centers)), centers, centers), "euclidean").select("id", "cluster")
    out.rests_on = [points]
    return out


class Bfr:
    """BFR: a discard set of k summaries, a compression set of further ones, and retained points.

    fit() takes (id, features, round). The first `sample` points of the first round (by id) are clustered
    with 5k centers; clusters of 1 to `rare` points are outliers, the others make the discard set by the best of several k-means,
    the outliers' own clusters of several points the compression set. The other points, round by round, go to
    the nearest discard cluster with a squared Mahalanobis distance below 3 * dim, else to such a compression
    cluster, else to the retained points; the summaries are frozen within a round and then updated at once, so
    the order of points has no influence. After a round the retained points are clustered anew, from the same
    first points in memory or by Spark, and compression
    clusters closer than the bound merged, each at most once. At the end compression clusters go to the nearest
    discard cluster by Mahalanobis, retained points by Euclidean distance.
    """

    def __init__(self, k: int, seed: int = 0, sample: int = 10_000, rare: int = 3):
        self.k, self.seed, self.sample, self.rare = k, seed, sample, rare

    def fit(self, points: DataFrame) -> Bfr:
        spark = self.spark = points.sparkSession
        ship(spark)
        points = materialize(points.select("id", "features", "round"), "bfr-points")
        self.stats: list[tuple] = []
        self.cs = Summaries(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)))
        #: number of the compression cluster that a numbered one was merged into
        self.alias: dict[int, int] = {}
        self.cs_ids: list[int] = []
        self.kept: list[DataFrame] = []
        self.retained = spark.createDataFrame([], "id long, features array<double>")
        rounds = [r[0] for r in points.select("round").distinct().orderBy("round").collect()]
        for number, which in enumerate(rounds, 1):
            now = points.where(F.col("round") == which).select("id", "features")
            if number == 1:
                now = self._begin(now)
            self._assign(now)
            self._recluster()
            self._merge()
            held = self.retained.count()
            self.stats.append((number, self.k_found, int(self.ds.n.sum()), len(self.cs), int(self.cs.n.sum()), held))
        discard(points)
        return self

    def rounds(self) -> DataFrame:
        return self.spark.createDataFrame(self.stats, ROUND_FIELDS)

    def labels(self) -> DataFrame:
        """(id, cluster) of all points."""
        target = {}
        if len(self.cs):
            near = self.ds.mahalanobis(self.cs.centroid).argmin(axis=1)
            target = {c: int(t) for c, t in zip(self.cs_ids, near)}
        moved = [(c, target[self._root(c)]) for c in {*self.alias, *self.cs_ids}]
        moved = self.spark.createDataFrame(moved, "cs int, cluster int")  # the compression clusters there ever were
        out = nearest(self.retained, self.ds, "euclidean").select("id", "cluster")
        for df in self.kept:
            inside = df.where("cs is null").select("id", "cluster")
            out = out.unionByName(inside).unionByName(attach(df.where("cs is not null").select("id", "cs"), moved, ["cs"], "inner", ["id"]).select("id", "cluster"))
        return out

    def _root(self, c: int) -> int:
        while c in self.alias:
            c = self.alias[c]
        return c

    def _begin(self, now: DataFrame) -> DataFrame:
        rows = now.orderBy("id").limit(self.sample).collect()  # bounded by the parameter
        ids, x = np.array([r["id"] for r in rows]), np.array([r["features"] for r in rows], np.float64)
        self.dim = x.shape[1]
        label = lloyd(x, seeded_order(ids, self.seed), 5 * self.k)
        count = np.bincount(label)
        out = count[label] <= self.rare
        if out.all():
            out[:] = False
        inner = steadier_lloyd(x[~out], ids[~out], self.k, self.seed)
        self.k_found = int(inner.max()) + 1
        self.ds = Summaries.of(x[~out], inner, self.k_found)
        schema = "id long, cluster int, cs int"
        self.kept.append(self.spark.createDataFrame([(int(i), int(c), None) for i, c in zip(ids[~out], inner)], schema))
        self._take(ids[out], x[out])
        return now.where(F.col("id") > int(ids.max())) if len(ids) == self.sample else now.limit(0)

    def _take(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Cluster retained points in memory: clusters of several become compression clusters."""
        single = np.ones(len(ids), bool)
        if len(ids):
            label = lloyd(x, seeded_order(ids, self.seed), 5 * self.k)
            count = np.bincount(label)
            single = count[label] == 1
            self._compress(Summaries.of(x, label, len(count)), [(int(i), int(c)) for i, c in zip(ids[~single], label[~single])], count > 1)
        rows = [(int(i), [float(v) for v in p]) for i, p in zip(ids[single], x[single])]
        self.retained = self.spark.createDataFrame(rows, "id long, features array<double>")

    def _compress(self, sums: Summaries, members: list[tuple[int, int]] | DataFrame, several: np.ndarray) -> None:
        at = np.flatnonzero(several)
        first = max([-1, *self.cs_ids, *self.alias]) + 1
        number = {int(c): first + i for i, c in enumerate(at)}
        self.cs = self.cs.joined(sums.pick(list(at)))
        self.cs_ids += list(number.values())
        if isinstance(members, list):
            members = self.spark.createDataFrame([(i, None, number[c]) for i, c in members], "id long, cluster int, cs int")
        else:
            pairs = self.spark.createDataFrame(list(number.items()), "label int, cs int")  # at most 5k rows
            members = attach(members, pairs, ["label"], "inner", ["id"]).select("id", F.lit(None).cast("int").alias("cluster"), "cs")
        self.kept.append(members)

    def _assign(self, now: DataFrame) -> None:
        ds, cs, numbers, bound = self.ds, self.cs, self.cs_ids, 3 * self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("features"))
                if not len(x):
                    continue
                d = ds.mahalanobis(x)
                kind = np.where(d.min(axis=1) < bound, d.argmin(axis=1), -1)
                inside = np.full(len(x), -1)
                if len(cs):
                    c = cs.mahalanobis(x)
                    inside = np.where((kind < 0) & (c.min(axis=1) < bound), c.argmin(axis=1), -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kind.astype(np.int32)), pa.array(inside.astype(np.int32))], ["id", "features", "ds", "cs_at"])

        placed = materialize(now.mapInArrow(run, "id long, features array<double>, ds int, cs_at int"), "bfr-round")
        if (more := _collected(summarize(placed.where("ds >= 0"), "ds"), "ds", len(ds))) is not None:
            self.ds = ds.plus(more)
        if len(cs) and (more := _collected(summarize(placed.where("cs_at >= 0"), "cs_at"), "cs_at", len(cs))) is not None:
            self.cs = cs.plus(more)
        number = F.expr(f"case when cs_at >= 0 then element_at(array({','.join(f'{n}' for n in numbers) or '-1'}), cs_at + 1) end")
        kept = placed.where("ds >= 0 or cs_at >= 0").select("id", F.when(F.col("ds") >= 0, F.col("ds")).alias("cluster"), number.cast("int").alias("cs"))
        self.kept.append(materialize(kept, "bfr-kept"))
        left = placed.where("ds < 0 and cs_at < 0").select("id", "features")
        before, self.retained = self.retained, materialize(self.retained.unionByName(left), "bfr-retained")
        discard(before)
        discard(placed)

    def _recluster(self) -> None:
        n = self.retained.count()
        if 0 < n <= DRIVER_POINTS:
            rows = self.retained.orderBy("id").collect()
            before = self.retained
            self._take(np.array([r["id"] for r in rows]), np.array([r["features"] for r in rows], np.float64))
            discard(before)
        elif n:
            near = kmeans(self.retained, 5 * self.k, self.seed)
            label = materialize(self.retained.join(near.withColumnRenamed("cluster", "label"), "id"), "bfr-labels")
            discard(near)
            sums = _collected(summarize(label, "label"), "label", 5 * self.k)
            self._compress(sums, label.select("id", "label"), sums.n > 1)
            single = [int(c) for c in np.flatnonzero(sums.n == 1)]
            before, self.retained = self.retained, materialize(label.where(F.col("label").isin(single)).select("id", "features"), "bfr-retained")
            discard(before)

    def _merge(self) -> None:
        """One greedy pass in the order of the clusters; each is merged at most once."""
        if len(self.cs) < 2:
            return
        d = self.cs.mahalanobis(self.cs.centroid)
        close, used, keep = np.minimum(d, d.T) < 3 * self.dim, set(), []
        sums, ids = self.cs, self.cs_ids
        merged = Summaries(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)))
        names = []
        for i in range(len(sums)):
            if i in used:
                continue
            for j in range(i + 1, len(sums)):
                if j not in used and close[i, j]:
                    used |= {i, j}
                    merged = merged.joined(sums.pick([i]).plus(sums.pick([j])))
                    names.append(ids[i])
                    self.alias[ids[j]] = ids[i]
                    break
            if i not in used:
                keep.append(i)
        self.cs = merged.joined(sums.pick(keep)) if keep else merged
        self.cs_ids = names + [ids[i] for i in keep]
