"""Documents as sources: text files, and the splitter that cuts them to chunks by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BYTES = 2000


FILES = "path string, modificationTime timestamp, length long, content binary"


def read_texts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Files below a path as documents: path, modified, content, content_hash (over the bytes delivered)."""
    raw = (spark.readStream.schema(FILES) if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").load(path)
    return raw.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


def delivered(texts: DataFrame, name: str, late: str = "7 days") -> DataFrame:
    """A folder's files as deliveries of documents, each content of a document once; works on streams.

    ``name``: a pattern whose group is the document in the path; a document
    that changes is delivered as a file of another path. A content that comes
    again within ``late`` is no delivery, state is kept for as long.
    """
    rows = texts.select(F.regexp_extract("path", name, 1).alias("document"), "modified", "content", "content_hash")
    return rows.withWatermark("modified", late).dropDuplicatesWithinWatermark(["document", "content_hash"])


def versions(deliveries: DataFrame) -> DataFrame:
    """Deliveries with their version, from 1 by time; one with the content of the one before it is none."""
    own = Window.partitionBy("document").orderBy("modified", "content_hash")
    rows = deliveries.withColumn("before", F.lag("content_hash").over(own)).where("before IS NULL OR before <> content_hash").drop("before")
    return rows.withColumn("version", F.row_number().over(own))


def pieces(text: str, most: int = MAX_BYTES) -> list[str]:
    """Paragraphs packed greedily into pieces of at most ``most`` UTF-8 bytes; a longer one is cut at characters."""
    out: list[str] = []
    held, size = [], 0
    for paragraph in (p.strip() for p in text.split("\n\n")):
        raw = paragraph.encode()
        if not raw:
            continue
        if held and size + 2 + len(raw) > most:
            out.append("\n\n".join(held))
            held, size = [], 0
        if len(raw) <= most:
            held.append(paragraph)
            size += len(raw) + 2 * (len(held) > 1)
            continue
        at = 0
        while at < len(raw):
            end = min(at + most, len(raw))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            out.append(raw[at:end].decode())
            at = end
    if held:
        out.append("\n\n".join(held))
    return out


def split_documents(docs: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """id, seq, content of every document's pieces; packing by bytes needs a sequential pass, so it is an Arrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, p in enumerate(pieces(t or "", most))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["id", "seq", "content"])

    return docs.select("id", "content").mapInArrow(run, "id long, seq int, content string")
