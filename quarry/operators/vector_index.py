"""Dense recall with a vector index and a router: inverted lists where a scope sees much, an exact scan where it sees little.

Vectors are normalised and filed under the nearest of ``lists`` centroids, one
folder of files each. A query reads the files of the nearest lists alone. The
centroids are trained on a sample of a fixed bound (``SAMPLE`` vectors, taken
by a hash of the id); every vector is filed, whatever the sample.

The router adds up how many chunks each of the caller's principals sees (kept
with the index: a row for each tenant and principal). That is no less than what the caller
sees, so where it is small the scan over the visible chunks is exact and cheap;
else lists are read, more of them until ``k`` chunks are found, and all of
them if need be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieval import cosine, dense
from quarry.operators.scope import Scope, scoped_chunks
from quarry.sources.files import Files

#: Vectors that centroids are trained on, and rounds of training.
SAMPLE, ROUNDS = 20_000, 8
#: Visible chunks up to which a scan is exact.
EXACT_BOUND = 20_000
#: Share of the lists that a query reads first.
PROBED = 0.25

VECTORS = "id long, embedding array<double>"
VISIBLE = "tenant string, principal long, n long"
CENTROIDS = "list int, centroid array<double>"


@dataclass(frozen=True)
class VectorIndex:
    vectors: Files
    visible: Files
    centroids: Files

    def nearest(self, query: list[float]) -> list[int]:
        """Lists by similarity of their centroids."""
        rows = self.centroids.read().collect()  # a row for each list
        q = np.array(query)
        return [int(r["list"]) for r in sorted(rows, key=lambda r: (-float(np.array(r["centroid"]) @ q), r["list"]))]


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    return VectorIndex(Files(spark, f"{folder}/vectors", VECTORS), Files(spark, f"{folder}/visible", VISIBLE), Files(spark, f"{folder}/centroids", CENTROIDS))


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def trained(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means; a list that loses all its vectors starts again at the vector served worst."""
    x = _normal(sample)
    centroids = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ centroids.T
        of, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=len(centroids)) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        centroids = _normal(sums)
    return centroids


def build(chunks: DataFrame, vectors: DataFrame, folder: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Files every vector (id, embedding); chunks give the counts by principal. Zero and null vectors have no place, as they match nothing."""
    spark = vectors.sparkSession
    own = vectors.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = own.count()
    index = open_index(spark, folder)
    index.visible.add(chunks.where("valid_to IS NULL").select("tenant", F.explode("visibility").alias("principal")).groupBy("tenant", "principal").agg(F.count("*").alias("n")).coalesce(1))
    if not n:
        return index
    # the first ``sample`` by a hash of the id: top-k, so nothing else reaches the driver
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    centroids = trained(chosen.flatten().to_numpy().reshape(len(chosen), -1), lists or max(1, min(4096, round(math.sqrt(n)))))
    load = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x @ load.value.T).argmax(axis=1).astype(np.int32))], names=["id", "embedding", "list"])

    filed = own.mapInArrow(run, "id long, embedding array<double>, list int")
    # dealt by list and a salt, so that a list of any size is written by several tasks
    dealt = filed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (1_000_000 * len(centroids))))))
    index.vectors.add(dealt, F.col("list"))
    index.centroids.add(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], CENTROIDS).coalesce(1))
    return index


def sees_at_most(index: VectorIndex, scope: Scope) -> int:
    """No fewer than the chunks that a scope sees."""
    rows = index.visible.read().where((F.col("tenant") == scope.tenant) & F.col("principal").isin(*scope.principals)) if scope.principals else index.visible.read(())
    return rows.agg(F.sum("n")).head()[0] or 0


def recall_routed(index: VectorIndex, chunks: DataFrame, vectors: DataFrame, scope: Scope, query: list[float], k: int, bound: int = EXACT_BOUND, probed: float = PROBED) -> DataFrame:
    """id, score of the k nearest scoped chunks: exact for scopes that see up to ``bound``, else from the nearest lists."""
    if sees_at_most(index, scope) <= bound:
        return dense(chunks, vectors, scope, query, k)
    order = index.nearest(query)
    names, seen = index.vectors.names(), scoped_chunks(chunks, scope).select("id")
    take = max(1, round(len(order) * probed))
    while True:
        rows = index.vectors.read(names, order[:take]).select("id", cosine(F.col("embedding"), query).alias("score"))
        found = seen.join(rows, "id").orderBy(F.desc("score"), "id").limit(k)
        if take >= len(order) or found.count() >= k:
            return found
        take = min(len(order), 2 * take)
