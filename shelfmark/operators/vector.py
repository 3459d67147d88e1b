"""Dense and sparse nearest neighbours, exact by default, with an optional inverted-file index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from shelfmark.operators.bm25 import top_k
from shelfmark.session import new_folder, spread, stored

MIN_K, MAX_K, DEFAULT_K = 1, 100, 15
#: Queries that are broadcast at a time; a larger set is searched block by block.
QUERY_BLOCK = 2048
METRICS = ("ip", "cosine", "l2")


def check_k(k: int) -> int:
    if not MIN_K <= k <= MAX_K:
        raise ValueError(f"k must be from {MIN_K} to {MAX_K}")
    return k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def similarity(a: Column, b: Column, metric: str = "ip") -> Column:
    """Higher is nearer: inner product, cosine, or the negative Euclidean distance."""
    if metric == "cosine":
        return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    if metric == "l2":
        return F.lit(0.0) - F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    return dot(a, b)


def _row_blocks(queries: DataFrame, key: str, vector: str) -> Iterator[list[tuple]]:
    rows = []
    for r in queries.where(_whole(vector)).select(key, vector).toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == QUERY_BLOCK:
            yield rows
            rows = []
    if rows:
        yield rows


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for rows in _row_blocks(queries, key, vector):
        yield np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


#: Scores of pairs that a task holds at a time, and pairs that are scored again one by one.
TILE, PAIRS = 1 << 20, 1 << 14


class _Best:
    """The k best vectors of each query among those that a task has seen; ties by id.

    Pairs are scored in tiles of bounded size by one matrix product. Those that can reach a query's k-th best so far are
    scored again one by one, so that a score does not depend on how rows are cut into batches. Scores that are no numbers
    are left out, or come first (``nan_first``), as in the order of SQL.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str = "ip", digits: int = 6, nan_first: bool = False):
        self.ids, self.q, self.k, self.metric, self.digits, self.nan_first = ids, q, k, metric, digits, nan_first
        self.sizes = np.sqrt((q * q).sum(1))
        self.odd = ~np.isfinite(q).all(1)
        self.floor = np.full(len(ids), -np.inf)
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query's place, id, score

    def add(self, names: np.ndarray, v: np.ndarray, asked: np.ndarray | None = None) -> None:
        """More vectors, for all queries or those at the places ``asked``."""
        asked = np.arange(len(self.ids)) if asked is None else asked
        if not len(asked):
            return
        step = max(1, TILE // len(asked))
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            for i in range(0, len(names), step):
                self._tile(names[i : i + step], v[i : i + step], asked)

    def _tile(self, names: np.ndarray, v: np.ndarray, asked: np.ndarray) -> None:
        size, floor = np.sqrt((v * v).sum(1)), self.floor[asked]
        near = self.q[asked] @ v.T
        # how far off a score of the product may be, and the least one that counts
        bad = ~np.isfinite(v).all(1)
        longest = size[~bad].max(initial=0.0)
        off = 1e-12 * self.sizes[asked] * longest
        least = floor - 10.0**-self.digits - off
        if self.metric == "cosine":
            near /= self.sizes[asked][:, None]
            near /= size[None]
            least = floor - 10.0**-self.digits - 1e-12
        elif self.metric == "l2":
            near *= 2
            near -= (size * size)[None]
            near -= (self.sizes[asked] ** 2)[:, None]
            reach = 10.0**-self.digits - floor
            least = -reach * reach - 1e-12 * (self.sizes[asked] ** 2 + longest**2)
        chosen = near >= least[:, None]
        if len(names) > 4 * self.k and np.count_nonzero(chosen) > 4 * self.k * len(asked):
            # a first tile: what ties with the k-th of the tile, or nearly, is enough
            kth = np.partition(np.where(np.isnan(near), -np.inf, near), len(names) - self.k, axis=1)[:, len(names) - self.k]
            apart = (2 * 10.0**-self.digits) * (np.sqrt(np.maximum(-kth, 0)) + 1) if self.metric == "l2" else 2 * 10.0**-self.digits
            slack = 2e-12 * (self.sizes[asked] ** 2 + longest**2) if self.metric == "l2" else 2 * off + 2e-12
            chosen &= near >= (kth - apart - slack)[:, None]
        chosen[:, bad] = True
        chosen[self.odd[asked]] = True
        place, row = np.nonzero(chosen)
        if len(place):
            score = np.concatenate([self._scores(asked[place[j : j + PAIRS]], v, row[j : j + PAIRS]) for j in range(0, len(place), PAIRS)])
            have = ~np.isnan(score) | (self.nan_first & ((bad[row] | self.odd[asked[place]])))
            self._keep(asked[place][have], names[row][have], score[have])

    def _scores(self, place: np.ndarray, v: np.ndarray, row: np.ndarray) -> np.ndarray:
        a, b = self.q[place], v[row]
        if self.metric == "l2":
            return np.round(0.0 - np.sqrt(((a - b) ** 2).sum(1)), self.digits)
        score = (a * b).sum(1)
        if self.metric == "cosine":
            sizes = self.sizes[place] * np.sqrt((b * b).sum(1))
            score = np.where(sizes != 0, score / sizes, np.nan)
        return np.round(score, self.digits)

    def _keep(self, place: np.ndarray, names: np.ndarray, score: np.ndarray) -> None:
        place, names, score = (np.concatenate(x) for x in zip(self.held, (place, names, score)))
        number = ~np.isnan(score)
        order = np.lexsort((names, -np.where(number, score, 0), number, place))
        ordered = place[order]
        rank = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.held = place[order], names[order], score[order]
        self.floor[place[last]] = np.where(number[last], score[last], np.inf)

    def found(self) -> pa.RecordBatch:
        place, names, score = self.held
        return pa.RecordBatch.from_arrays([pa.array(self.ids[place]), pa.array(names), pa.array(score, from_pandas=False)], names=["query_id", "id", "score"])


_FOUND = StructType([StructField("query_id", LongType()), StructField("id", LongType()), StructField("score", DoubleType())])


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, metric: str = "ip", where: Column | None = None, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "embedding", digits: int = 6, nan_first: bool = False) -> DataFrame:
    """``query_id, id, score, rank``: the k nearest of all vectors that pass ``where``, for each query; ties by id.

    The filter comes before the ranking. Rows and queries without a vector are left out, and under cosine a pair with a
    zero vector, which has no direction. Queries go out in blocks of bounded size; each task scores them in tiles and keeps
    its own k best, so that the shuffle carries k rows a query and task.
    """
    check_k(k)
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    source = spread((vectors if where is None else vectors.where(where)).where(_whole(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")))
    out = None
    for ids, rows in _blocks(queries, query_key, query_vector):
        sent = vectors.sparkSession.sparkContext.broadcast((ids, rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = _Best(*sent.value, k, metric, digits, nan_first)
            for batch in batches:
                if batch.num_rows:
                    best.add(batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("v")))
            yield best.found()

        found = source.mapInArrow(run, _FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], _FOUND)
    return top_k(out, k, "query_id", [F.desc("score"), F.asc("id")])


def dense_top_k_columns(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, metric: str = "ip", key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "embedding", digits: int = 6) -> DataFrame:
    """The same with the order of Column expressions (``similarity``): scores that are no numbers come first.

    A row for each pair takes about 2 microseconds of an expression over arrays, so pairs are scored in tiles here too.
    """
    return dense_top_k(vectors, queries, k, metric, None, key, vector, query_key, query_vector, digits, nan_first=True)


def _whole(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())


def sparse_top_k(postings: DataFrame, query_terms: DataFrame, k: int = DEFAULT_K, drop_ratio: float = 0.0, digits: int = 6) -> DataFrame:
    """``query_id, id, score, rank`` from ``postings(id, term, weight)`` and ``query_terms(query_id, term, weight)``.

    Inner products over common terms; ``drop_ratio`` leaves out that share of each query's terms, the lightest first.
    """
    check_k(k)
    asked = query_terms
    if drop_ratio > 0:
        from pyspark.sql import Window

        by_weight = Window.partitionBy("query_id").orderBy("weight", "term")
        every = Window.partitionBy("query_id")
        asked = asked.withColumn("__place", F.row_number().over(by_weight)).withColumn("__all", F.count("*").over(every)).where(F.col("__place") > F.floor(F.col("__all") * drop_ratio)).drop("__place", "__all")
    joined = asked.select("query_id", "term", F.col("weight").alias("qw")).join(postings.select("id", "term", F.col("weight").alias("dw")), "term")
    scored = joined.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qw") * F.col("dw")), digits).alias("score"))
    return top_k(scored, k, "query_id", [F.desc("score"), F.asc("id")])


def _kept(names: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by name; what has no score is left out."""
    have = np.flatnonzero(~np.isnan(score))
    if len(have) > 4 * k:
        have = have[score[have] >= -np.partition(-score[have], k - 1)[k - 1]]  # all that tie with the k-th stay
    return have[np.lexsort((names[have], -score[have]))[:k]]


class InvertedFile:
    """K-means cells over all vectors, stored as a table that is partitioned by cell; searches read the cells they probe.

    ``vectors`` under ``path`` holds ``id, v`` in a folder for each cell; ``cells`` has each cell's centre, its number of
    vectors and its radius, the largest distance of one of them from the centre. Centres are fitted on a seeded sample
    of at most ``sample`` vectors; every vector that is not null is assigned. There are about as many cells as the square
    root of the number of vectors, at most MOST_CELLS.
    """

    MOST_CELLS = 4096

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MOST_CELLS rows
        self.names = np.array([r["cell"] for r in found], np.int64)
        self.centers = np.array([r["center"] for r in found], np.float64)
        self.sizes = np.array([r["n"] for r in found], np.int64)
        self.radii = np.array([r["radius"] for r in found], np.float64)
        self.table = spark.read.parquet(f"{path}/vectors") if len(found) else None

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", sample: int = 100_000, seed: int = 42) -> InvertedFile:
        """Writes the index under ``path`` (by default a new folder in the shared one)."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        path = path or new_folder(spark)
        rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        n = rows.count()
        chosen = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select(array_to_vector("v").alias("features"))
        wanted = min(cells or max(1, round(n**0.5)), cls.MOST_CELLS, max(1, n))
        centers = np.array(KMeans(k=wanted, seed=seed, maxIter=10).fit(chosen).clusterCenters()) if n > 1 else np.array([r["v"] for r in rows.collect()])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column("v"))
                step, lengths = max(1, TILE // len(centers)), (centers * centers).sum(1)
                cell = np.concatenate([(lengths[None] - 2 * v[i : i + step] @ centers.T).argmin(1) for i in range(0, len(v), step)])
                off = np.sqrt(((v - centers[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(off), pa.array(cell.astype(np.int32))], names=["id", "v", "off", "cell"])

        # rows of a cell are gathered before writing; one with very many is split
        assigned = rows.mapInArrow(assign, "id long, v array<double>, off double, cell int").hint("rebalance", "cell")
        assigned.write.partitionBy("cell").parquet(f"{path}/vectors")
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
        if n:
            sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius"))
            table = table.join(sizes, "cell")
        else:
            table = table.withColumns({"n": F.lit(0).cast("long"), "radius": F.lit(0.0)})
        table.write.parquet(f"{path}/cells")
        return cls(spark, path)

    def probed(self, cells: list[int]) -> DataFrame:
        """The rows of some cells; other folders are not read."""
        return self.table.where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int = DEFAULT_K, share: float = 0.75, exact: bool = False, query_key: str = "query_id", query_vector: str = "embedding", digits: int = 6) -> DataFrame:
        """``query_id, id, score, rank``: the k best by inner product, ties by id.

        Each query probes the cells that are nearest to it, until they hold ``share`` of all vectors (0.75 keeps a recall
        of 0.9 even where vectors have no clusters; clustered ones need far less). ``exact`` then also reads every cell
        that could hold a better one: no vector of a cell scores more than its centre does plus the query's length times
        the radius. Queries go out in blocks; a batch of vectors meets only the queries that probe its cell.
        """
        check_k(k)
        order = [F.desc("score"), F.asc("id")]
        out = None
        for ids, q in _blocks(queries, query_key, query_vector) if self.table is not None else ():
            middle = q @ self.centers.T
            near = np.argsort((self.centers * self.centers).sum(1)[None] - 2 * middle, 1, kind="stable")
            before = np.cumsum(self.sizes[near], 1) - self.sizes[near]
            probes = np.zeros(near.shape, bool)
            np.put_along_axis(probes, near, before < share * self.sizes.sum(), 1)
            found = self._scored(ids, q, probes, k, digits)
            if exact:
                found = stored(top_k(found, k, "query_id", order).drop("rank"))
                worst = {r["query_id"]: (r["n"], r["worst"]) for r in found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).collect()}  # one of each query
                floor = np.array([worst[i][1] if i in worst and worst[i][0] >= k else -np.inf for i in ids.tolist()])
                most = middle + np.linalg.norm(q, axis=1)[:, None] * self.radii[None]
                more = ~probes & (most + 10.0**-digits >= floor[:, None])
                if more.any():
                    found = found.unionByName(self._scored(ids, q, more, k, digits))
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.spark.createDataFrame([], _FOUND)
        return top_k(out, k, "query_id", order)

    def _scored(self, ids: np.ndarray, q: np.ndarray, probes: np.ndarray, k: int, digits: int) -> DataFrame:
        place = {int(c): i for i, c in enumerate(self.names)}
        sent = self.spark.sparkContext.broadcast((ids, q, probes, place))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, probes, place = sent.value
            best = _Best(ids, q, k, digits=digits)
            for batch in batches:
                cell, names, v = batch.column("cell").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("v"))
                for c in np.unique(cell):
                    here = np.flatnonzero(cell == c)
                    best.add(names[here], v[here], np.flatnonzero(probes[:, place[int(c)]]))
            yield best.found()

        wanted = self.names[probes.any(0)].tolist()
        return self.probed(wanted).select("id", "v", "cell").mapInArrow(run, _FOUND)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
