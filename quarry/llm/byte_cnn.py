"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks, from the first byte to
the last; learned filters run over each chunk and are max-pooled there. Over
a document's chunks, the maximum and the mean of the pooled responses go
through a small dense layer to one probability. Nothing but the text is an
input of the score.

Training takes the labelled documents with the smallest hashes of doc_id, each
with its whole text, up to ``max_labelled`` of them and up to ``max_bytes``
bytes in all; both bounds are parameters, so the training set fits the driver
at any size of corpus. Scoring reads every byte of every document, in blocks of
bounded size however long it is, and needs no shuffle: the weights (some 40 kB)
are all that is sent.

Cases: a null or empty text is one chunk of padding and gets a score; labels
that are null, or of documents that are not there, teach nothing; of several
labels of one document the smallest counts; with no labels, or labels of one
kind only, every score is that kind's share (0.5 without any). A null doc_id
is never held out; rows that repeat a doc_id teach once and are scored each; a
score of exactly 0.5 predicts 1; a table without rows gives none. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, blocks, carried
from quarry.session import table

CHUNK, OVERLAP, WIDTH, STEP, DEPTH, FILTERS, HIDDEN = 512, 64, 8, 2, 8, 32, 16
MAX_LABELLED, MAX_BYTES, STEPS, BATCH, RATE, SEED = 4000, 64 << 20, 600, 32, 0.01, 20


def chunks_of(text: bytes) -> np.ndarray:
    """(n, CHUNK) codes: 0 is padding, b + 1 a byte b. All bytes are covered."""
    n = max(1, -(-(len(text) - OVERLAP) // (CHUNK - OVERLAP)))
    padded = np.zeros((n - 1) * (CHUNK - OVERLAP) + CHUNK, np.int16)
    padded[: len(text)] = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[:: CHUNK - OVERLAP]


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s, by=1.0: (r.standard_normal(s) * by).astype(np.float32)
        return cls(n(257, DEPTH, by=0.5), n(WIDTH * DEPTH, FILTERS, by=(WIDTH * DEPTH) ** -0.5), np.zeros(FILTERS, np.float32), n(2 * FILTERS, HIDDEN, by=(2 * FILTERS) ** -0.5), np.zeros(HIDDEN, np.float32), n(HIDDEN, by=HIDDEN**-0.5), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]

    def pooled(self, codes: np.ndarray, where: bool = False):
        """Max-pooled responses of each chunk, and where each maximum stands."""
        flat = np.lib.stride_tricks.sliding_window_view(self.embed[codes].reshape(len(codes), -1), WIDTH * DEPTH, axis=1)[:, :: STEP * DEPTH]
        n, places = flat.shape[:2]
        response = (flat.reshape(-1, WIDTH * DEPTH) @ self.filters).reshape(n, places, FILTERS)
        best = np.maximum(response.max(axis=1) + self.bias, 0)
        return (best, response.argmax(axis=1)) if where else best

    def head(self, pooled: np.ndarray, starts: np.ndarray):
        """Probability of each document from its chunks' rows, which begin at starts."""
        size = np.diff(np.append(starts, len(pooled)))[:, None]
        features = np.concatenate([np.maximum.reduceat(pooled, starts, axis=0), np.add.reduceat(pooled, starts, axis=0) / size], axis=1)
        hidden = np.maximum(features @ self.dense + self.dense_bias, 0)
        return 1 / (1 + np.exp(-(hidden @ self.out + self.out_bias))), features, hidden

    def score(self, texts: list[bytes], most: int = 1024) -> np.ndarray:
        """Scores of whole texts, in blocks of about ``most`` chunks."""
        out, held, n = np.empty(len(texts)), [], 0

        def flush(upto: int) -> None:
            nonlocal held, n
            if held:
                starts = np.cumsum([0, *[len(h) for h in held[:-1]]])
                out[upto - len(held) : upto] = self.head(np.concatenate(held), starts)[0]
            held, n = [], 0

        for i, text in enumerate(texts):
            codes = chunks_of(text)
            held.append(np.concatenate([self.pooled(codes[k : k + 256]) for k in range(0, len(codes), 256)]))
            n += len(codes)
            if n >= most:
                flush(i + 1)
        flush(len(texts))
        return out


def fit(documents: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Network:
    """Adam on the cross-entropy; documents: each one's chunks as codes."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        net.out[:] = 0
        net.out_bias[:] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return net
    first, second, t = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    epochs = max(1, round(steps / -(-len(labels) // BATCH)))
    total = epochs * -(-len(labels) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            t += 1
            gradient = _gradient(net, [documents[i] for i in order[at : at + BATCH]], labels[order[at : at + BATCH]].astype(np.float32))
            rate = RATE * (1 - (t - 1) / total)
            for p, g, a, b in zip(net.parameters(), gradient, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def _gradient(net: Network, documents: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    codes, sizes = np.concatenate(documents), np.array([len(d) for d in documents])
    starts = np.cumsum(np.append(0, sizes[:-1]))
    found = [net.pooled(codes[k : k + 256], where=True) for k in range(0, len(codes), 256)]
    pooled, at = (np.concatenate(c) for c in zip(*found, strict=True))
    p, features, hidden = net.head(pooled, starts)
    d_logit = (p - labels) / len(labels)
    d_hidden = np.outer(d_logit, net.out) * (hidden > 0)
    d_features = d_hidden @ net.dense.T
    of = np.repeat(np.arange(len(sizes)), sizes)
    top = pooled == features[of, :FILTERS]
    ties = np.add.reduceat(top.astype(np.float32), starts, axis=0)
    d_pooled = (d_features[of, :FILTERS] * top / ties[of] + d_features[of, FILTERS:] / sizes[of, None]) * (pooled > 0)
    d_filters, d_embed = np.zeros_like(net.filters), np.zeros((257, DEPTH))
    for k in range(0, len(codes), 256):
        own, d_own = slice(k, k + 256), d_pooled[k : k + 256]
        seen = codes[own][np.arange(len(d_own))[:, None, None], at[own][:, :, None] * STEP + np.arange(WIDTH)]  # (chunk, filter, place)
        patches = net.embed[seen].reshape(len(d_own), FILTERS, -1)
        d_filters += np.einsum("cf,cfk->kf", d_own, patches, optimize=True)
        back = (d_own[:, :, None] * net.filters.T[None]).reshape(-1, DEPTH)
        d_embed += np.stack([np.bincount(seen.ravel(), back[:, c], 257) for c in range(DEPTH)], axis=1)
    return [d_embed.astype(np.float32), d_filters, d_pooled.sum(axis=0), features.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d_logit, np.array([d_logit.sum()])]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, steps: int = STEPS) -> Network:
    """Learns from rows of labels (doc_id, quality) that are not held out, each document's whole text."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled rows of two numbers: bounded, so it may be broadcast
    taught = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").cast("int").alias("quality"))
    # the same few rows, in one order: a running total of their bytes
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    upto = F.sum(size).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = taught.withColumn("upto", upto).where((F.col("upto") <= max_bytes) | (F.col("upto") == size)).select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, qualities = [], []
        for batch in batches:
            documents += [chunks_of((t or "").encode()) for t in batch.column(1).to_pylist()]
            qualities += batch.column(2).to_pylist()
        net = fit(documents, np.array(qualities, np.float32), steps)
        shapes, values = [list(p.shape) for p in net.parameters()], [p.astype(np.float32).tobytes() for p in net.parameters()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(shapes, pa.list_(pa.int32())), pa.array(values, pa.binary())], names=["place", "shape", "bytes"])

    # the sample is bounded and learned from in one task, so the driver holds no text of it, only the weights
    learned = arrow_map(rows.coalesce(1).sortWithinPartitions("doc_id"), run, "place int, shape array<int>, bytes binary").collect()
    if not learned:
        return fit([], np.array([], np.float32), steps)
    return Network(*[np.frombuffer(bytes(r["bytes"]), np.float32).reshape(r["shape"]).copy() for r in sorted(learned, key=lambda r: r["place"])])


def scored(docs: DataFrame, network: Network, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and score of every document, with the columns of carry as a struct."""
    rows, schema, names = carried(docs, carry)
    cast = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            score = cast.value.score([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), *batch.columns[2:]], names=["doc_id", "text", "score", *names])

    return arrow_map(rows, run, "doc_id long, text string, score double" + schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored(docs, network).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
