"""Subscriptions: new rows that a scope may see, each at least once, in order of (recorded_at, id)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.scope import Scope, scoped
from quarry.session import kept, shared_dir


def stream_table(spark, path: str) -> DataFrame:
    """A table as a stream of its files; the schema is that of the files now there. A table may be one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(conf).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_once(df: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None, idle: bool = True) -> str:
    """Takes what is available, appends it to a folder and returns the folder; a checkpoint makes runs resume.

    ``idle``: whether batches without data follow while they may yield something. State with a time to live
    may always, so a run over it would never end.
    """
    spark = df.sparkSession
    before = spark.conf.get(IDLE)
    spark.conf.set(IDLE, str(idle).lower())
    base = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = out or f"{base}/out"
    try:
        query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint or f"{base}/state").trigger(availableNow=True).start(out)
    finally:
        spark.conf.set(IDLE, before)
    query.awaitTermination()
    return out


#: Rows of one poll.
PAGE = 256

#: A place in the order of delivery: (occurred_at, action_id).
Mark = tuple[int, int]
START: Mark = (-(1 << 62), -(1 << 62))


class StaleFence(RuntimeError):
    """Revocations may be missing: nothing is delivered until the membership watch has caught up."""


def subscribe(rows: DataFrame, scope_now: Callable[[], Scope], deliver: Callable[[DataFrame, int], None], checkpoint: str, fence: Callable[[], bool] = lambda: False) -> StreamingQuery:
    """Hands each batch's visible rows on. The scope is compiled anew for every batch, so revocations take hold at once.

    A batch that meets a stale fence fails, is not committed, and comes again when the subscription is started anew.
    """

    def each(batch: DataFrame, number: int) -> None:
        if fence():
            raise StaleFence(f"batch {number}")
        deliver(scoped(batch, scope_now()), number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after(rows: DataFrame, mark: Mark, most: int = PAGE) -> DataFrame:
    """The next rows after a high-water mark (occurred_at, action_id); rows of one time are not skipped."""
    new = rows.where(F.struct("occurred_at", "action_id") > F.struct(F.lit(mark[0]).cast("long"), F.lit(mark[1]).cast("long")))
    return new.orderBy("occurred_at", "action_id").limit(most)


def poll(rows: DataFrame, scope: Scope, mark: Mark, fence: bool = False, most: int = PAGE) -> tuple[DataFrame, Mark]:
    """(the next visible rows after a mark, the mark behind them); the mark stays where there are none."""
    if fence:
        raise StaleFence(str(mark))
    page = kept(after(scoped(rows, scope), mark, most))
    last = page.agg(F.max(F.struct("occurred_at", "action_id")).alias("m")).head()["m"]
    return page, mark if last is None else (last["occurred_at"], last["action_id"])
