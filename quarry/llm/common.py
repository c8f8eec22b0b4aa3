"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.session import shared_dir

#: Texts handled together in Python are cut to batches of about this many
#: bytes, whatever number of rows Spark puts in an Arrow batch.
BATCH_BYTES = 4 << 20
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key with more than this share of all rows is joined by broadcast: there are at most as many of them.
HOT_KEYS = 4096

_written: list[tuple[SparkSession, str]] = []


def arrow_rows(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes before they reach Python, unless the session sets its own bound.

    Documents may be very long, so a number of rows does not bound an executor's memory.
    """
    if spark.conf.get(BYTES) == "67108864b":  # Spark's default
        spark.conf.set(BYTES, str(4 * BATCH_BYTES))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again.

    This cuts the lineage: a lost executor costs only its own tasks, and
    nothing is computed twice. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(discard_all)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def marked() -> int:
    """A point in time, for discard_since."""
    return len(_written)


def discard_since(mark: int, keep: int = 1) -> None:
    """Deletes what saved() wrote after a mark, but for the last tables, whose data nothing before them is needed for."""
    for spark, path in _written[mark : len(_written) - keep]:
        remove(spark, path)
    del _written[mark : len(_written) - keep]


def discard_all() -> None:
    """Deletes what saved() wrote; a session that has ended is passed over."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            try:
                remove(spark, path)
            except Exception:  # noqa: BLE001  the JVM may have gone first
                return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``text``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = _byte_ends(column)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = start + 1
            if ends[-1] - base > most:
                import numpy as np

                stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            else:
                stop = batch.num_rows
            yield batch.slice(start, stop - start)
            start = stop


def _byte_ends(column: pa.Array):
    import numpy as np
    import pyarrow.compute as pc

    return np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    arrow_rows(df.sparkSession)
    return df.mapInArrow(fn, schema)


def with_values(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the one row of ``values`` of their key; values has ``n``, how many of ``total`` rows have that key.

    Keys that hold over a share of 1 / HOT_KEYS of all rows would each fill one
    task; there are HOT_KEYS of them at most, so those are broadcast.
    """
    from pyspark.sql import functions as F

    least = max(1, total // HOT_KEYS)
    hot = F.broadcast(values.where(F.col("n") > least).drop("n").withColumn("is_hot", F.lit(True)))
    both = rows.join(hot, key, "left")
    cold = both.where(F.col("is_hot").isNull()).select(*rows.columns).join(values.where(F.col("n") <= least).drop("n"), key)
    return both.where(F.col("is_hot").isNotNull()).drop("is_hot").unionByName(cold)


def carried(docs: DataFrame, carry: tuple[str, ...]) -> tuple[DataFrame, str, list[str]]:
    """doc_id, text and, as one struct, the columns to be carried along; its part of a schema; its name."""
    from pyspark.sql import functions as F

    if not carry:
        return docs.select("doc_id", "text"), "", []
    rows = docs.select("doc_id", "text", F.struct(*carry).alias("carried"))
    return rows, f", carried {rows.schema['carried'].dataType.simpleString()}", ["carried"]
