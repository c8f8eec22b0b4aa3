"""Recall: exact cosine, BM25, and their fusion by reciprocal ranks.

Every leg ranks scoped rows only. Scores are rounded to six places and ties
go to the smaller id, so results do not depend on partitioning; each leg ends
in a top-k, which Spark takes per partition before anything moves.

BM25 reads an index that follows its chunks (``quarry.operators.postings``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import postings
from quarry.operators.postings import Index, bm25, build_index
from quarry.operators.scope import Scope, drop_reasons, scoped_chunks

__all__ = ["Index", "bm25", "build_index"]

RRF = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, query: list[float]) -> Column:
    """Cosine of a double array against a fixed vector, whose norm is a literal; null if either is zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = math.sqrt(sum(x * x for x in query))
    return F.round(F.try_divide(dot(a, q), F.sqrt(dot(a, a)) * F.lit(norm)), 6)


def dense(chunks: DataFrame, vectors: DataFrame, scope: Scope, query: list[float], k: int) -> DataFrame:
    """id, score of the k nearest scoped chunks. Vectors are scored where they are read: ids and scores alone cross the join."""
    scores = vectors.where(F.col("embedding").isNotNull()).select("id", cosine(F.col("embedding"), query).alias("score"))
    return scoped_chunks(chunks, scope).select("id").join(scores, "id").select("id", "score").orderBy(F.desc("score"), "id").limit(k)


#: Queries that are multiplied with vectors together, and blocks of them that one pass over the vectors takes.
QUERY_BLOCK, PASS_BLOCKS = 1_000, 16


def dense_many(chunks: DataFrame, vectors: DataFrame, scope: Scope, queries: DataFrame, k: int) -> DataFrame:
    """qid, id, score: the k nearest scoped chunks of each query (qid, embedding), a block of queries at a time.

    Each task multiplies its vectors with the block and keeps k for each query,
    so k rows a query and task are all that is shuffled.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("qid", "embedding").orderBy("qid").collect()  # the stated query set
    seen = scoped_chunks(chunks, scope).select("id").join(vectors.where(F.col("embedding").isNotNull()).select("id", "embedding"), "id")
    out = None
    for at in range(0, len(asked), QUERY_BLOCK * PASS_BLOCKS):
        taken = asked[at : at + QUERY_BLOCK * PASS_BLOCKS]
        blocks = []
        for first in range(0, len(taken), QUERY_BLOCK):
            matrix = np.array([r["embedding"] for r in taken[first : first + QUERY_BLOCK]], np.float64)
            blocks.append((first, matrix, np.linalg.norm(matrix, axis=1)))
        load = queries.sparkSession.sparkContext.broadcast((np.array([r["qid"] for r in taken], np.int64), blocks))

        def run(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            ids, blocks = load.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                length = np.linalg.norm(x, axis=1)
                for first, matrix, norms in blocks:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = np.round((x @ matrix.T) / (length[:, None] * norms[None, :]), 6)
                    for q in range(len(norms)):
                        use = np.isfinite(score[:, q])
                        s, i = np.append(best[first + q][0], score[use, q]), np.append(best[first + q][1], own[use])
                        top = np.lexsort((i, -s))[:k]
                        best[first + q] = s[top], i[top]
            sizes = [len(b[1]) for b in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))], names=["qid", "id", "score"])

        found = seen.mapInArrow(run, "qid long, id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], "qid long, id long, score double")
    return _top(out, k)


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def bm25_many(index: Index, chunks: DataFrame, scope: Scope, queries: DataFrame, k: int) -> DataFrame:
    """qid, id, score of the k best scoped chunks of each query (qid, text): one pass over the terms' postings."""
    return _top(postings.best_many(index, chunks, scope, queries, k), k)


def composite(hits: DataFrame, now: int, half_life: int = 30 * 86_400) -> DataFrame:
    """Ranks episodic hits (id, score, at, trust_tier, importance, kind) by similarity, recency, tier and importance; facts do not age."""
    recency = F.when(F.col("kind") == "fact", 1.0).otherwise(F.pow(F.lit(0.5), (F.lit(now) - F.col("at")) / half_life))
    tier = F.when(F.col("trust_tier") == 1, 1.0).when(F.col("trust_tier") == 2, 0.9).otherwise(0.8)
    return hits.withColumn("rank_score", F.round(F.col("score") * recency * tier * F.coalesce("importance", F.lit(1.0)), 6))


def fuse(legs: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal-rank fusion of legs (id, score), each a top-k already."""
    order = Window.orderBy(F.desc("score"), "id")
    ranked = [leg.select("id", F.row_number().over(order).alias("rank")) for leg in legs]
    rows = ranked[0]
    for leg in ranked[1:]:
        rows = rows.unionByName(leg)
    return rows.groupBy("id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def recall(index: Index, chunks: DataFrame, vectors: DataFrame, scope: Scope, k: int, text: str | None = None, vector: list[float] | None = None) -> DataFrame:
    """Hybrid recall, or a single leg where only a text or a vector is given."""
    legs = ([dense(chunks, vectors, scope, vector, k)] if vector is not None else []) + ([bm25(index, chunks, scope, text, k)] if text else [])
    if not legs:
        raise ValueError("a recall needs a text, a vector or both")
    return legs[0] if len(legs) == 1 else fuse(legs, k)


def debug_trace(chunks: DataFrame, vectors: DataFrame, scope: Scope, query: list[float], n: int) -> DataFrame:
    """The tenant's n nearest chunks whoever asks, with every reason why the scope drops them."""
    scores = vectors.select("id", cosine(F.col("embedding"), query).alias("score"))
    rows = chunks.where(F.col("tenant") == scope.tenant).select("id", "tenant", "visibility", "confidentiality", "tags", "kind", "valid_to").join(scores, "id")
    top = rows.orderBy(F.desc("score"), "id").limit(n)
    return top.select("id", "score", F.array_join(F.array_sort(drop_reasons(top, scope)), ",").alias("reasons"))


def freshness_gate(hits: DataFrame, heartbeats: DataFrame, now: int, bound: int, k: int) -> DataFrame:
    """Over-fetched hits (id, source, score) with their source's verdict; stale ones go, then k stay.

    heartbeats: source, last_seen (registry sources only; null: never synced).
    """
    rows = hits.join(heartbeats.withColumn("registered", F.lit(True)), "source", "left")
    exempt = F.col("source").isin("agent") | F.col("source").startswith("webhook:") | F.col("source").startswith("folder:") | F.col("registered").isNull()
    verdict = F.when(exempt, "exempt").when(F.col("last_seen").isNull(), "never_synced").when(now - F.col("last_seen") <= bound, "fresh").otherwise("stale")
    return rows.withColumn("verdict", verdict).where(F.col("verdict").isin("exempt", "fresh")).select("id", "source", "score", "verdict").orderBy(F.desc("score"), "id").limit(k)


def near_knowledge(items: DataFrame, query: list[float], categories: list[str], floor: float = 0.45, k: int = 8) -> DataFrame:
    """Knowledge that a new statement may merge with: id, status, categories, embedding."""
    rows = items.where(F.col("status").isin("candidate", "published"))
    if categories:
        rows = rows.where(F.coalesce(F.arrays_overlap("categories", F.array(*map(F.lit, categories))), F.lit(False)))
    return rows.select("id", cosine(F.col("embedding"), query).alias("score")).where(F.col("score") >= floor).orderBy(F.desc("score"), "id").limit(k)
