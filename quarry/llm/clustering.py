"""Centroid clustering by sort-means.

Every round orders, for each centroid, the others by their distance from it. A
vector starts at the centroid it was assigned to last and looks at the others
in that order; where a centroid stands strictly further from the starting one
than twice the vector's current distance, it and all behind it are further
away, by the triangle inequality, and the scan ends. A centroid at exactly twice
the distance may tie and is still looked at. All of it is in whole numbers
(squared distances: strictly more than four times), so nothing is rounded.

Scale: the centroids are broadcast, ``k`` vectors whatever the corpus. A round is
one pass over the vectors without a shuffle, which writes them with their
assignment (the next round starts from it, and a lost executor costs its own
tasks of one round), and an aggregate of ``k`` rows that combines before it
shuffles; the table before it is removed. Only sums and counts by cluster reach
the driver. A cluster may hold any share of the vectors.

Cases: vectors that are null, of another width, or hold a component that is
null or no finite number are left out; components over 2 ** 27 in size count as
2 ** 27; equal vectors get equal clusters; rows that repeat a vec_id count each,
also as first centroids; a null vec_id is never a first centroid and is
clustered as any other; with fewer vectors than ``k`` there are fewer centroids, without
any there are no rows; an empty cluster keeps its centroid. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, discard_since, marked, saved
from quarry.llm.vectors import floored, matrix, parts_of, usable
from quarry.session import table

CLUSTERS, ROUNDS, WIDTH, SEED = 40, 5, 64, 2
#: Vectors that a task assigns at once.
BLOCK_ROWS = 4096


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Ordered:
    """Centroids, and for each the others by distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = np.stack([_squared(centroids, c) for c in centroids])
        np.fill_diagonal(apart, -1)  # each stands first in its own order, before any equal one
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def assign(self, vectors: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (ties: the smaller number) and squared distance of every vector; how many distances were worked out."""
        best, least = start.copy(), _squared(vectors, self.centroids[start])
        looked = len(vectors)
        for c in np.unique(start):
            own = np.flatnonzero(start == c)
            # how far down the order each vector has to look; those that look furthest come first
            reach = np.searchsorted(self.apart[c], 4 * least[own], "right")
            own, reach = own[np.argsort(-reach, kind="stable")], np.sort(reach)[::-1]
            for at in range(1, int(reach[0])):
                going = own[: np.searchsorted(-reach, -at, "left")]  # reach > at
                other = self.order[c, at]
                distance = _squared(vectors[going], self.centroids[other])
                nearer = (distance < least[going]) | ((distance == least[going]) & (other < best[going]))
                best[going[nearer]], least[going[nearer]] = other, distance[nearer]
                looked += len(going)
        return best, least, looked


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (vec_id, v, cluster) with the cluster and squared distance by these centroids."""
    load = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = Ordered(load.value)
        for batch in parts_of(batches, BLOCK_ROWS):
            cluster, distance, _ = ordered.assign(matrix(batch.column(1), load.value.shape[1]), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])

    return arrow_map(rows.select("vec_id", "v", "cluster"), run, "vec_id long, v array<int>, cluster int, distance long")


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid with vectors at the floor of their mean, component by component."""
    width = centroids.shape[1]
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.element_at("v", i + 1).cast("long")).alias(f"s{i}") for i in range(width)))
    out = centroids.copy()
    for r in sums.collect():  # k rows at most
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def first_centroids(rows: DataFrame, k: int, rank: Column) -> np.ndarray:
    """The k vectors with the smallest rank; equal ranks by their components."""
    chosen = rows.where(rank.isNotNull()).orderBy(rank, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in chosen], np.int64)


def clustered(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, v, cluster, distance, cluster_inertia, inertia, centroid_sha256 of rows (vec_id, v of integers, equally wide)."""
    spark = rows.sparkSession
    mark = marked()
    rows = saved(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.lit(0).alias("cluster")), "vectors")
    centroids = first_centroids(rows, k, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, v array<int>, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        rows = saved(assigned(rows, centroids), "assigned")
        discard_since(mark)
        centroids = _moved(rows, centroids)
    rows = saved(assigned(rows, centroids), "assigned")
    discard_since(mark)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    total = sum(sums.values())
    facts = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    by_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(by_cluster), "cluster").select("vec_id", "v", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def integer_vectors(embeddings: DataFrame, width: int = WIDTH) -> DataFrame:
    """vec_id and v of the usable vectors of a width, components as integers."""
    return embeddings.where(usable("embedding") & (F.size("embedding") == width)).select("vec_id", floored("embedding").alias("v"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(integer_vectors(table(spark, sf_dir, "embeddings"))).drop("v")


def _oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """One pair of tables a round: assignments, then centroids, component by component."""
    sql = [
        """e AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "x AS MATERIALIZED (SELECT i, unnest(range(1, 65)) AS d, unnest(v) AS x FROM e)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('2:' || vec_id) AS h FROM e WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        sql.append(
            f"a{r} AS MATERIALIZED (SELECT i, c, distance FROM (SELECT i, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS distance FROM x JOIN (SELECT c, unnest(range(1, 65)) AS d, unnest(v) AS y FROM c{r}) USING (d) GROUP BY i, c) "
            "QUALIFY row_number() OVER (PARTITION BY i ORDER BY distance, c) = 1)"
        )
        if r < rounds:
            sql.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m, v) AS v FROM c{r} LEFT JOIN (SELECT c, list(m ORDER BY d) AS m FROM (SELECT c, d, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m "
                f"FROM a{r} JOIN x USING (i) GROUP BY c, d) GROUP BY c) USING (c))"
            )
    return f"""WITH {", ".join(sql)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(f.v, lambda z: CAST(z AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN e USING (i) JOIN c{rounds} f ON a.c = f.c"""


ORACLE_OP12 = _oracle()
