"""Centroids, drift, clustering and projection of dense vectors."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (PCA, CountVectorizerModel, ElementwiseProduct, Normalizer,
                                StopWordsRemover)
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.vector import cosine, drift_band, euclidean, squared_norm
from newsloom.operators.bounds import broadcast_if_small, rows_if_small
from newsloom.session import materialize

MAX_LOCAL_CENTROIDS = 4096  # rows; a few megabytes at some hundred dimensions
MAX_PIVOTS = 1024
MAX_KEPT_WORDS = 400_000
FEW_TASKS = 16


# --- centroids -------------------------------------------------------------------------

def centroids(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, centroid, n): mean vector per group, as mergeable partial sums."""
    out = df.groupBy(*by).agg(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m"),
        F.count("*").alias("n"))
    return out.select(*by, vector_to_array("m").alias("centroid"), "n")


def merge_means(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Centroids of groups given as (centroid, n) parts: the counts weigh the means."""
    out = parts.groupBy(*by).agg(
        Summarizer.mean(array_to_vector("centroid"), F.col("n").cast("double")).alias("m"),
        F.sum("n").alias("n"))
    return out.select(*by, vector_to_array("m").alias("centroid"), "n")


def nearest_centroid(df: DataFrame, key: str, vector: str, cents: DataFrame) -> DataFrame:
    """(key, centroid_id, similarity): most similar centroid if the cosine is above 0.

    ``cents(id, centroid)``; ties go to the lower id. One row out for each row in; a null
    vector, or none above 0, gives (null, 0). Up to ``MAX_LOCAL_CENTROIDS`` the centroids
    travel to the tasks as one matrix and each Arrow batch is one product. Beyond, a vector meets
    only the cells of a ``CentroidIndex`` that may hold its nearest centroid. Both ways give the
    same rows.
    """
    id_type = cents.schema["id"].dataType
    usable = cents.select("id", "centroid").filter("id is not null and centroid is not null")
    small = rows_if_small(usable.orderBy("id"), MAX_LOCAL_CENTROIDS)
    if small == []:
        return df.select(key, F.lit(None).cast(id_type).alias("centroid_id"),
                         F.lit(0.0).alias("similarity"))
    if small is not None:
        ids = F.array(*[F.lit(r["id"]).cast(id_type) for r in small])
        matrix = np.array([r["centroid"] for r in small], dtype=float)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

        @F.pandas_udf("at int, sim double")  # positions, so that ids never pass through pandas
        def best(vectors: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame({"at": -1, "sim": 0.0}, index=vectors.index)
            given = vectors.notna().to_numpy()
            if given.any():
                rows = np.stack(vectors[given].to_numpy()).astype(float)
                length = np.linalg.norm(rows, axis=1)
                sims = rows @ unit.T
                sims = np.divide(sims, length[:, None], out=np.zeros_like(sims),
                                 where=length[:, None] > 0)
                at = sims.argmax(axis=1)
                top = sims[np.arange(len(rows)), at]
                out.loc[given, "at"] = np.where(top > 0, at, -1)
                out.loc[given, "sim"] = np.maximum(top, 0.0)
            return out.astype({"at": "int32"})

        hit = df.select(key, best(F.col(vector)).alias("b"))
        return hit.select(key, F.when(F.col("b.at") >= 0, F.get(ids, F.col("b.at")))
                          .alias("centroid_id"), F.col("b.sim").alias("similarity"))

    # Equal rows travel once; their number brings them back.
    once = df.groupBy(F.col(key).alias("k"), F.col(vector).alias("v")).agg(F.count("*").alias("n"))
    once = materialize(once.withColumn("no", F.monotonically_increasing_id()), "vectors")
    index = CentroidIndex(usable)
    near = materialize(index.nearest(once, index.first_cell("v")), "nearest")
    again = once.join(near, "no", "left")
    rest = index.nearest(again, index.other_cells("v", F.coalesce(-F.col("best.neg"), F.lit(0.0))))
    best = near.unionByName(rest).groupBy("no").agg(F.min("best").alias("best"))
    found = once.join(best, "no", "left")
    positive = F.col("best.neg") < 0
    return found.select(
        F.col("k").alias(key), F.when(positive, F.col("best.c")).alias("centroid_id"),
        F.when(positive, -F.col("best.neg")).otherwise(0.0).alias("similarity"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("__copy")).drop("__copy")


def _far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the vectors at length 1: each the farthest from those taken before."""
    if not len(vectors):
        return vectors
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    taken, nearest = [0], unit @ unit[0]
    while len(taken) < min(count, len(unit)):
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[taken[-1]])
    return unit[taken]


class CentroidIndex:
    """Centroids in cells around pivots, for the exact nearest one by cosine.

    The pivots, at most ``MAX_PIVOTS`` centroids far apart of a hashed pick of four times as many,
    and each cell's largest angle to its pivot are all that the driver holds. No member of a cell is nearer to a vector than the
    angle between vector and pivot less that largest angle. So a vector meets the cell whose pivot is
    nearest, and then only the cells that could hold a centroid at least as near as the one it found.
    """

    def __init__(self, cents: DataFrame, most: int = MAX_PIVOTS):
        rows = cents.select("id", F.col("centroid").cast("array<double>").alias("centroid")).filter(
            squared_norm(F.col("centroid")) > 0)
        count = min(most, 2 * math.isqrt(rows.count()) + 1)
        picked = rows.orderBy(F.xxhash64("centroid"), "id").limit(4 * count).select("centroid").collect()
        self.pivots = pivots = _far_apart(np.array([r[0] for r in picked], dtype=float), count)
        self.cells = materialize(rows.select(
            F.explode(self.first_cell("centroid")).alias("cell"), F.col("id").alias("c"), "centroid",
            self._angle("centroid").alias("angle")), "cells")
        radii = np.full(len(pivots), -np.inf)  # a cell without members is out of reach
        for cell, angle in self.cells.groupBy("cell").agg(F.max("angle")).collect():
            radii[cell] = angle
        self.radii = radii

    def _angles(self):
        pivots = self.pivots

        def angles(vectors: pd.Series) -> np.ndarray:
            rows = np.stack(vectors.to_numpy()).astype(float)
            length = np.linalg.norm(rows, axis=1, keepdims=True)
            sims = np.divide(rows @ pivots.T, length, out=np.zeros((len(rows), len(pivots))),
                             where=length > 0)
            return np.arccos(np.clip(sims, -1, 1))

        return angles

    def _angle(self, vector: str) -> Column:
        angles = self._angles()

        @F.pandas_udf("double")
        def nearest(vectors: pd.Series) -> pd.Series:
            return pd.Series(angles(vectors).min(axis=1))

        return nearest(F.col(vector))

    def first_cell(self, vector: str) -> Column:
        """A list of the cell with the nearest pivot; empty without a vector."""
        angles = self._angles()

        @F.pandas_udf("array<int>")
        def nearest(vectors: pd.Series) -> pd.Series:
            given = vectors.notna().to_numpy()
            found = iter(angles(vectors[given]).argmin(axis=1) if given.any() else ())
            return pd.Series([[int(next(found))] if g else [] for g in given], dtype=object)

        return nearest(F.col(vector))

    def other_cells(self, vector: str, similarity: Column) -> Column:
        """The other cells that may hold a centroid of at least that similarity (above 0)."""
        angles, radii = self._angles(), self.radii

        @F.pandas_udf("array<int>")
        def reach(vectors: pd.Series, sims: pd.Series) -> pd.Series:
            given = vectors.notna().to_numpy()
            if not given.any():
                return pd.Series([[]] * len(vectors), dtype=object)
            turned = angles(vectors[given])
            limit = np.arccos(np.clip(sims[given].to_numpy(), 0, 1))[:, None] + 1e-6
            near = turned - radii <= limit
            near[np.arange(len(near)), turned.argmin(axis=1)] = False
            found = iter(near)
            return pd.Series([np.flatnonzero(next(found)).tolist() if g else [] for g in given],
                             dtype=object)

        return reach(F.col(vector), similarity)

    def nearest(self, rows: DataFrame, cells: Column) -> DataFrame:
        """(no, best) of ``rows`` (no, v): the least (neg, c), minus similarity and id, in the cells.

        Only the best per vector leaves a task; adaptive execution splits a cell that many meet.
        """
        dealt = rows.select("no", "v", F.explode(cells).alias("cell"))
        similarity = F.coalesce(cosine(F.col("v"), F.col("centroid")), F.lit(0.0))
        pairs = dealt.join(self.cells, "cell").select("no", F.struct(
            (-similarity).alias("neg"), "c").alias("pair"))
        return pairs.groupBy("no").agg(F.min("pair").alias("best"))


# --- drift -----------------------------------------------------------------------------

def set_drift(old: DataFrame, new: DataFrame, vector: str) -> DataFrame:
    """(drift, band): 1 - cosine of the two sets' centroids."""
    after = centroids(new, vector).select("centroid").scalar()
    both = centroids(old, vector).withColumn("after", after)
    return both.select((1 - cosine(F.col("centroid"), F.col("after"))).alias("drift")).withColumn(
        "band", drift_band(F.col("drift")))


def drift_series(df: DataFrame, ts: str, vector: str, width: str = "4 hours",
                 min_docs: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(by…, bucket, n, drift) against the previous bucket that had enough documents.

    The window runs over one row per bucket, after the aggregation.
    """
    bucketed = df.withColumn("bucket", F.window(ts, width)["start"])
    series = centroids(bucketed, vector, [*by, "bucket"]).filter(F.col("n") >= min_docs)
    previous = F.lag("centroid").over(W.partitionBy(*by).orderBy("bucket"))
    out = series.withColumn("previous", previous).filter(F.col("previous").isNotNull())
    return out.select(*by, "bucket", "n",
                      (1 - cosine(F.col("previous"), F.col("centroid"))).alias("drift"))


def flag_spikes(series: DataFrame, sigmas: float = 1.5, value: str = "drift") -> DataFrame:
    """Adds ``is_spike``: above the mean plus ``sigmas`` population deviations.

    The series, one row per bucket, is read twice and therefore written.
    """
    series = materialize(series, "series")
    limit = series.agg(F.avg(value) + F.stddev_pop(value) * sigmas).scalar()
    return series.withColumn("__limit", limit).withColumn(
        "is_spike", F.col(value) > F.col("__limit")).drop("__limit")


# --- clustering ------------------------------------------------------------------------

def _features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


@dataclass(frozen=True)
class KMeansCenters:
    """Centres (k x dimensions), the sum of squared distances to them, and the passes it took."""

    centers: np.ndarray
    cost: float
    passes: int


def _starts(sample: np.ndarray, k: int, n_init: int, seed: int) -> np.ndarray:
    """Starting centres of each restart: drawn far apart from the sample (k-means++)."""
    out = np.empty((n_init, k, sample.shape[1]))
    for restart in range(n_init):
        draw = np.random.default_rng((seed, restart))
        at = draw.integers(len(sample))
        nearest = np.full(len(sample), np.inf)
        for c in range(k):
            out[restart, c] = sample[at]
            nearest = np.minimum(nearest, ((sample - sample[at]) ** 2).sum(axis=1))
            total = nearest.sum()
            at = draw.choice(len(sample), p=nearest / total) if total > 0 else draw.integers(len(sample))
    return out


def _advance(blocks: DataFrame, centers: dict[int, np.ndarray], few: bool) -> dict[int, tuple]:
    """One pass for all running restarts: each one's (sums, counts, cost) over its clusters.

    Sums of tasks add up by a shuffle, or on the driver if there are ``few`` tasks.
    """
    runs = sorted(centers)
    stacked = np.stack([centers[r] for r in runs])
    squares = (stacked ** 2).sum(axis=2)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, k, dim = stacked.shape
        sums, counts, cost = np.zeros((r, k, dim)), np.zeros((r, k)), np.zeros((r, k))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw).reshape(-1, dim)
                own = (x ** 2).sum(axis=1)
                for run in range(r):
                    apart = squares[run] - 2 * x @ stacked[run].T
                    at = apart.argmin(axis=1)
                    chosen = np.zeros((len(x), k))
                    chosen[np.arange(len(x)), at] = 1.0
                    sums[run] += chosen.T @ x
                    counts[run] += chosen.sum(axis=0)
                    cost[run] += np.maximum(own + apart.min(axis=1), 0) @ chosen
        flat = np.concatenate((sums, counts[..., None], cost[..., None]), axis=2).reshape(r * k, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(r * k), pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))],
            ["at", "figures"])

    parts = blocks.mapInArrow(assign, "at int, figures array<double>")
    if not few:
        parts = parts.groupBy("at").agg(vector_to_array(Summarizer.sum(array_to_vector("figures"))))
    found = np.zeros((stacked.shape[0] * stacked.shape[1], stacked.shape[2] + 2))
    for batch in parts.toArrow().to_batches():  # a row for each centre, of each task if they are few
        figures = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
        np.add.at(found, batch.column(0).to_numpy(), figures)
    found = found.reshape(*stacked.shape[:2], -1)
    return {r: (f[:, :-2], f[:, -2], f[:, -1].sum()) for r, f in zip(runs, found)}


def fit_kmeans(df: DataFrame, vector: str, k: int = 8, n_init: int = 20, max_iter: int = 500,
               seed: int = 42, tol: float = 1e-4, sample: int = 4096) -> KMeansCenters:
    """The best of ``n_init`` k-means fits by cost, all advanced in the same passes.

    The vectors are written once, in blocks. A pass reads them and moves the centres of every restart
    that still runs; what leaves a task is one row of sums for each centre, and these add up before
    and after the shuffle. A restart ends when its centres' squared moves add up to at most ``tol``
    times the vectors' mean variance, or after ``max_iter`` passes. Starts are drawn from a hashed
    pick of at most ``sample`` vectors; all vectors count in the passes. Null vectors are left out.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], ["block"])

    blocks = materialize(rows.mapInArrow(pack, "block binary"), "vector-blocks")
    picked = np.array([r[0] for r in rows.orderBy(F.xxhash64("v"), "v").limit(sample).collect()], float)
    if len(picked) < k:
        raise ValueError(f"{k} clusters need {k} vectors")
    limit = tol * picked.var(axis=0).mean()
    few = blocks.rdd.getNumPartitions() <= FEW_TASKS
    centers = dict(enumerate(_starts(picked, k, n_init, seed)))
    done: dict[int, KMeansCenters] = {}
    for turn in range(1, max_iter + 1):
        for run, (sums, counts, cost) in _advance(blocks, centers, few).items():
            filled = counts[:, None] > 0
            moved = np.divide(sums, counts[:, None], out=centers[run].copy(), where=filled)
            if ((moved - centers[run]) ** 2).sum() <= limit or turn == max_iter:
                done[run] = KMeansCenters(moved, cost, turn)
                del centers[run]
            else:
                centers[run] = moved
        if not centers:
            break
    return done[min(done, key=lambda r: (done[r].cost, r))]


def assign_clusters(df: DataFrame, model: KMeansCenters, vector: str) -> DataFrame:
    """Adds ``cluster`` and the distance to its centre; a null vector has neither."""
    centers = model.centers

    @F.pandas_udf("cluster int, distance double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cluster": None, "distance": None}, index=vectors.index, dtype=object)
        given = vectors.notna().to_numpy()
        if given.any():
            x = np.stack(vectors[given].to_numpy()).astype(float)
            apart = np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)
            out.loc[given, "cluster"] = apart.argmin(axis=1)
            out.loc[given, "distance"] = np.sqrt(apart.min(axis=1))
        return out.astype({"cluster": "Int32", "distance": "Float64"})

    placed = df.select("*", nearest(F.col(vector).cast("array<double>")).alias("__k"))
    return placed.withColumns({"cluster": F.col("__k.cluster"), "distance": F.col("__k.distance")}).drop("__k")


def with_confidence(df: DataFrame, distance: str = "distance") -> DataFrame:
    """Adds ``confidence`` = 1 - distance / largest distance; 1 if all are 0."""
    largest = df.agg(F.max(distance)).scalar()
    return df.withColumn("__max", largest).withColumn("confidence", F.when(
        F.col("__max") > 0, 1 - F.col(distance) / F.col("__max")).otherwise(1.0)).drop("__max")


def cluster_distances(df: DataFrame, cluster: str, vector: str, cents: DataFrame) -> DataFrame:
    """Distance of each row to its own cluster's centroid (``cents(cluster, centroid)``)."""
    return df.join(broadcast_if_small(cents, 50_000), cluster).withColumn(
        "distance", euclidean(F.col(vector), F.col("centroid"))).drop("centroid")


def cluster_sizes(df: DataFrame, cluster: str = "cluster", top: int = 15) -> DataFrame:
    return df.filter(F.col(cluster) != -1).groupBy(cluster).agg(F.count("*").alias("size")).orderBy(
        F.desc("size"), cluster).limit(top)


def cluster_totals(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters found, rows in clusters, noise rows (cluster -1)."""
    inside = F.col(cluster) != -1
    return df.agg(F.countDistinct(F.when(inside, F.col(cluster))).alias("clusters"),
                  F.count_if(inside).alias("clustered"), F.count_if(~inside).alias("noise"))


def _word_counts(words: DataFrame) -> DataFrame:
    """(word, n, docs) of a list column: occurrences and rows. The null word has the number of rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            coded = pc.dictionary_encode(lists.flatten())
            at, width = coded.indices.to_numpy(), len(coded.dictionary)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            n = np.bincount(at, minlength=width)
            docs = np.bincount(np.unique(row * width + at) % max(width, 1), minlength=width)
            names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays(
                [names, *[pa.array(np.append(x, batch.num_rows)) for x in (n, docs)]], ["word", "n", "docs"])

    return words.mapInArrow(count, "word string, n long, docs long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def tfidf(df: DataFrame, text: str, terms: int = 1000,
          stop_words: Sequence[str] | None = None) -> DataFrame:
    """Adds unit-length ``features``: counts of the most frequent terms times smoothed idf.

    Words are runs of two or more word characters in lower case. One pass over the texts counts them
    and the texts they are in; the vocabulary is read off the counts, without the stop words.
    """
    stop = list(stop_words) if stop_words is not None else \
        StopWordsRemover.loadDefaultStopWords("english")
    words = F.split(F.lower(F.col(text)), r"(?U)\W+")
    counts = _word_counts(df.select(words.alias("words")))
    best = counts.filter(F.col("word").isNull() | (
        (F.length("word") > 1) & ~F.col("word").isin([w.lower() for w in stop]))).orderBy(
        F.col("word").isNotNull(), F.desc("n"), "word").limit(terms + 1).collect()
    rows = best[0].n if best else 0
    model = CountVectorizerModel.from_vocabulary([r.word for r in best[1:]], "__words", "__tf")
    counted = model.transform(df.withColumn("__words", words))
    weights = Vectors.dense([math.log((rows + 1) / (r.docs + 1)) + 1 for r in best[1:]])
    weighted = ElementwiseProduct(scalingVec=weights, inputCol="__tf",
                                  outputCol="__w").transform(counted)
    unit = Normalizer(p=2.0, inputCol="__w", outputCol="features").transform(weighted)
    return unit.drop("__words", "__tf", "__w")


def clustering_benchmark(sets: dict[str, DataFrame], ks: Sequence[int] = (5, 10, 15),
                         max_iter: int = 20, seed: int = 42) -> DataFrame:
    """(method, k, silhouette) for data sets that carry a ``features`` vector."""
    rows = []
    for method, df in sets.items():
        data = df.select("features").persist()
        for k in ks:
            model = KMeans(k=k, maxIter=max_iter, seed=seed).fit(data)
            score = ClusteringEvaluator().evaluate(model.transform(data))
            rows.append((method, k, float(score)))
        data.unpersist()
    spark = next(iter(sets.values())).sparkSession
    return spark.createDataFrame(rows, "method string, k int, silhouette double")


def project_2d(df: DataFrame, vector: str) -> DataFrame:
    """Adds x, y: the first two principal components."""
    data = _features(df, vector)
    model = PCA(k=2, inputCol="features", outputCol="__p").fit(data)
    xy = vector_to_array("__p")
    return model.transform(data).withColumns({"x": xy[0], "y": xy[1]}).drop("features", "__p")


def cluster_centers_2d(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


# --- model slot --------------------------------------------------------------------------

def embed(text: Column, make_predict: Callable, batch_size: int = 256) -> Column:
    """Vectors from a user's model: ``make_predict()`` loads it once per Python worker and
    returns a function from an array of texts to a matrix."""
    return predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()),
                             batch_size=batch_size)(text)


def hash_embedder(dim: int = 64) -> Callable:
    """Deterministic stand-in model: hashed bag of words, unit length."""
    def make():
        import zlib

        class Codes(dict):
            def __missing__(self, word):
                value = self[word] = zlib.crc32(word.encode())
                return value

        codes = Codes()

        def predict(texts: np.ndarray) -> np.ndarray:
            if len(codes) > MAX_KEPT_WORDS:
                codes.clear()
            found = [list(map(codes.__getitem__, str(text).lower().split())) for text in texts]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            code = np.fromiter(itertools.chain.from_iterable(found), np.int64, len(row))
            out = np.bincount(row * dim + code % dim, np.where(code & 0x10000, 1.0, -1.0),
                              len(found) * dim).reshape(-1, dim).astype(np.float32)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, norms, out=out, where=norms > 0)

        return predict

    return make
