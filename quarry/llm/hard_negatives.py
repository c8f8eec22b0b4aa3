"""Hard-negative mining by distributed radix selection.

A window is an anchor and, for negatives, one of its positives: an interval of
scores in which the first ``k`` rows are wanted. Each round cuts the interval
of every window into ``buckets`` parts of equal width; tasks count their rows
by part (an integer histogram for each window), the histograms are added up,
and the part that holds the kth row becomes the interval of the next round, with
``k`` less what lies above it. After a few rounds the interval is one score.
Only then rows are gathered: those above it, all of which qualify, and of those
at it the smallest ids. Positives are selected likewise, with one window per
anchor over all scores.

Scale: every anchor meets every row, as the task has it, but as blocks of a
matrix product inside tasks. Pairs are never rows: a task gives at most ``k``
buckets per window and round, since the kth row of all is never behind the kth
row of a task, and at most ``k`` rows per window in the end. Anchors are taken in parts of
``PART_ANCHORS``, dealt by place and not by a key, so what is sent along, the
histograms in a task and the windows that reach the driver are all bounded;
rows are written once, as integers, and never shuffled. A lost executor costs
its own tasks of one round.

Cases: rows without a label, without a vector, or with a component that is null
or no finite number take no part; an empty vector has score 0 with all;
vectors of different widths are compared as if the shorter one ended in zeros;
components over 2 ** 27 in size count as 2 ** 27. Equal scores go by the
smaller vec_id, null ids last. Rows that repeat a vec_id count each, but those
with the anchor's own id are never its positives or negatives; an anchor that is repeated is
mined once for each row. A window that no row fits (as with negative scores of
positives) gives no rows; an anchor with fewer positives or negatives than
wanted gives all; tables without rows or anchors give none. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, saved
from quarry.llm.vectors import floored, matrix, parts_of, products, usable, widest
from quarry.session import table

#: Anchors that are mined together.
PART_ANCHORS = 1024
#: Parts into which a round cuts every interval of scores.
BUCKETS = 256
#: Rows that a task scores at once.
BLOCK_ROWS = 2048
#: Stands for a null id, behind all others.
NO_ID = np.iinfo(np.int64).max

POSITIVES, NEGATIVES = 5, 3


class Anchors(NamedTuple):
    """One part of the anchors."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


class Windows(NamedTuple):
    """Intervals of scores, by window: its anchor, bounds, and how many rows are still wanted of the interval.

    ``top`` is the upper bound at the start: what lies above ``high`` and not above ``top`` qualifies.
    """

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    top: np.ndarray
    wanted: np.ndarray

    def width(self, buckets: int) -> np.ndarray:
        return np.maximum(-(-(self.high - self.low + 1) // buckets), 1)


def _lanes(windows: Windows, n_anchors: int) -> Iterator[np.ndarray]:
    """Windows in groups that hold one window of an anchor at most: by anchor, its window or -1."""
    order = np.argsort(windows.anchor, kind="stable")
    of = windows.anchor[order]
    nth = np.arange(len(of)) - np.searchsorted(of, of, "left")
    for lane in range(int(nth.max(initial=-1)) + 1):
        own = np.full(n_anchors, -1)
        own[of[nth == lane]] = order[nth == lane]
        yield own


def _blocks(batches: Iterator[pa.RecordBatch], anchors: Anchors, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores by anchor and row, which of them may be chosen) of blocks of rows."""
    for batch in parts_of(batches, BLOCK_ROWS):
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        scores = products(anchors.vectors, matrix(batch.column(2), anchors.vectors.shape[1]))
        other = anchors.ids[:, None] != ids[None, :]
        yield ids, scores, other & ((anchors.labels[:, None] == labels[None, :]) == same)


def _places(scores: np.ndarray, may: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and row of the scores within each anchor's bounds."""
    return np.nonzero(may & (scores >= low[:, None]) & (scores <= high[:, None]))


def _counted(rows: DataFrame, load, same: bool, buckets: int) -> DataFrame:
    """(window, bucket, n): every task's histograms, as far as a task needs for the rows wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = load.value
        counts = np.zeros((len(windows.anchor), buckets), np.int64)
        lanes, width = list(_lanes(windows, len(anchors.ids))), windows.width(buckets)
        for _, scores, may in _blocks(batches, anchors, same):
            for own in lanes:
                low, high = np.where(own < 0, 1, windows.low[own]), np.where(own < 0, 0, windows.high[own])
                anchor, row = _places(scores, may, low, high)
                window = own[anchor]
                bucket = (high[anchor] - scores[anchor, row]) // width[window]
                np.add.at(counts, (window, bucket), 1)
        above = np.cumsum(counts, axis=1) - counts
        window, bucket = np.nonzero((counts > 0) & (above < windows.wanted[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(bucket.astype(np.int32)), pa.array(counts[window, bucket])], names=["window", "bucket", "n"])

    return arrow_map(rows, run, "window long, bucket int, n long")


def _narrowed(counted: DataFrame, windows: Windows, buckets: int) -> tuple[Windows, np.ndarray]:
    """The interval of every window's kth row; False for windows with fewer rows than wanted, which take all.

    The histograms are added up and the bucket is found by the cluster; one row per window comes back.
    """
    summed = counted.groupBy("window", "bucket").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("window").orderBy("bucket"))
    wanted = counted.sparkSession.createDataFrame(pa.table({"window": np.arange(len(windows.wanted)), "wanted": windows.wanted}))
    cut = summed.withColumn("upto", upto).join(F.broadcast(wanted), "window").where(F.col("upto") >= F.col("wanted"))
    low, high, left = windows.low.copy(), windows.high.copy(), windows.wanted.copy()
    full, width = np.zeros(len(low), bool), windows.width(buckets)
    for r in cut.groupBy("window").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("above")), "bucket").alias("at")).collect():
        w, b = r["window"], r["at"]["bucket"]
        high[w] = windows.high[w] - b * width[w]
        low[w] = max(windows.low[w], high[w] - width[w] + 1)
        left[w] -= r["at"]["above"]
        full[w] = True
    return windows._replace(low=low, high=high, wanted=left), full


def _gathered(rows: DataFrame, load, same: bool) -> DataFrame:
    """(window, score, vec_id): all rows above the last interval, and each task's smallest ids within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = load.value
        lanes = list(_lanes(windows, len(anchors.ids)))
        held = [np.empty(0, np.int64)] * 3

        for ids, scores, may in _blocks(batches, anchors, same):
            found = [held]
            for own in lanes:
                low, top = np.where(own < 0, 1, windows.low[own]), np.where(own < 0, 0, windows.top[own])
                anchor, row = _places(scores, may, low, top)
                found.append([own[anchor], scores[anchor, row], ids[row]])
            window, score, vec = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((vec, -score, window))
            window, score, vec = window[order], score[order], vec[order]
            tied = score <= windows.high[window]  # these stand behind the others of their window
            first = np.searchsorted(window * 2 + tied, window * 2 + tied, "left")
            keep = ~tied | (np.arange(len(window)) - first < windows.wanted[window])
            held = [window[keep], score[keep], vec[keep]]
        window, score, vec = held
        yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(score), pa.array(vec, mask=vec == NO_ID)], names=["window", "score", "vec_id"])

    return arrow_map(rows, run, "window long, score long, vec_id long")


def _selected(rows: DataFrame, anchors: Anchors, windows: Windows, same: bool, buckets: int) -> DataFrame:
    """(window, rank, score, vec_id) of the first rows of every window."""
    sc = rows.sparkSession.sparkContext
    k = int(windows.wanted.max(initial=0))
    open_ = np.ones(len(windows.anchor), bool)
    while (open_ & (windows.high > windows.low)).any():
        going = np.flatnonzero(open_ & (windows.high > windows.low))
        part = Windows(*(c[going] for c in windows))
        load = sc.broadcast((anchors, part))
        narrowed, full = _narrowed(_counted(rows, load, same, buckets), part, buckets)
        for column, new in zip(windows, narrowed, strict=True):
            column[going] = new
        open_[going[~full]] = False  # fewer rows than wanted: the whole interval
        load.destroy()
    # a window that takes its whole interval has nothing in a last interval
    whole = Windows(*windows)._replace(high=np.where(open_, windows.high, windows.low - 1))
    found = _gathered(rows, sc.broadcast((anchors, whole)), same)
    by = W.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _percent(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(score * percent / 100), without leaving 64 bits."""
    whole, rest = np.divmod(score, 100)
    return whole * percent + rest * percent // 100


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame, is_anchor, *, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = 50, high: int = 95, part_anchors: int = PART_ANCHORS, buckets: int = BUCKETS, id_column: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """The first negatives for every anchor and positive whose score is from low to high percent of the positive's.

    ``is_anchor``: a condition on rows. ``vector`` holds integers.
    """
    spark = rows.sparkSession
    held = saved(rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), is_anchor.alias("is_anchor")), "vectors")
    width = widest(held, "v")
    chosen = held.where("is_anchor")
    parts = max(1, -(-chosen.count() // part_anchors))
    largest = held.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("long")))))).head()[0] or 0
    numbered = chosen.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    points = held.select("vec_id", "label", "v")
    mined = []
    for p in range(parts):
        own = numbered.where(F.col("part") == p).select("vec_id", "label", "v").toArrow()
        vectors = matrix(own.column("v").combine_chunks(), width)
        anchors = Anchors(own.column("vec_id").to_numpy(), own.column("label").to_numpy(), vectors)
        n = len(anchors.ids)
        if not n:
            continue
        bound = np.abs(vectors).sum(axis=1) * largest
        windows = Windows(np.arange(n), -bound, bound.copy(), bound.copy(), np.full(n, n_positives))
        positives = _selected(points, anchors, windows, True, buckets).toArrow().sort_by([("window", "ascending"), ("rank", "ascending")])  # n_positives an anchor at most
        anchor, score = positives.column("window").to_numpy(), positives.column("score").to_numpy()
        least, most = -_percent(-score, low), _percent(score, high)
        pairs = Windows(anchor.copy(), least, most.copy(), most.copy(), np.full(len(anchor), n_negatives))
        names = pa.table({"window": pa.array(np.arange(len(anchor))), "anchor_id": pa.array(anchors.ids[anchor]), "positive_id": positives.column("vec_id"), "positive_score": pa.array(score)})
        if len(anchor):
            found = _selected(points, anchors, pairs, False, buckets).join(F.broadcast(spark.createDataFrame(names)), "window")
            mined.append(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
            if parts > 1:
                mined[-1] = saved(mined[-1], "mined")
    return reduce(DataFrame.unionByName, mined) if mined else spark.createDataFrame([], MINED)


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """The rows that take part: usable vectors with a label, components as integers, other columns gone."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(F.col("label").isNotNull() & usable("embedding")).select("vec_id", label.alias("label"), floored("embedding").alias("embedding"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_rows(table(spark, sf_dir, "embeddings"))
    return hard_negatives(rows, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


ORACLE_OP11 = """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
