"""Bi-temporal facts: the upsert state machine, as-of reads, retirement, access corrections, merged records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tenant", "source", "entity_id", "field"]
VERSION = "arrival long, valid_from long, value string, valid_to long, superseded_by long, outcome string"
VERSION_NAMES = [c.split()[0] for c in VERSION.split(", ")]


def versions(events: DataFrame) -> DataFrame:
    """Every version that events leave behind, in order of arrival per key.

    A first value is inserted. An equal value changes nothing, not even the
    time the current one is valid from. A value no newer than the current one
    is late and stored as closed history that ends where the current begins.
    Anything else supersedes. Where events have a column ``gone``, those that
    are gone close the current version at their time, and what comes next is a
    first value again. What is late depends on the current version alone, so
    neither a lag nor a running maximum says it: each key's events pass in order,
    as Arrow batches, and only the current version is held. A key with a long
    history takes time by its length, and no memory.
    """
    gone = F.coalesce("gone", F.lit(False)) if "gone" in events.columns else F.lit(False)
    rows = events.select(*KEY, F.col("arrival").cast("long").alias("arrival"), F.col("valid_from").cast("long").alias("valid_from"), F.col("value").cast("string").alias("value"), gone.alias("gone"))
    ordered = rows.repartition(*KEY).sortWithinPartitions(*KEY, "arrival", "valid_from", "value", "gone")
    keys = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in KEY)
    return ordered.mapInArrow(_folded, f"{keys}, {VERSION}")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Versions of events in order of key and arrival; a key may go on in the next batch."""
    key, now, schema = None, None, None

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        if schema is None:
            schema = pa.schema([*list(batch.schema)[: len(KEY)], *[pa.field(c, pa.string() if c in ("value", "outcome") else pa.int64()) for c in VERSION_NAMES]])
        out = []
        for *own, arrival, start, value, gone in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own != key:
                if now is not None:
                    out.append((*key, *now[:3], None, None, now[3]))
                key, now = own, None
            if gone:
                if now is not None:
                    out.append((*key, *now[:3], start, None, now[3]))
                now = None
            elif now is None:
                now = arrival, start, value, "inserted"
            elif value == now[2]:
                continue
            elif start is not None and now[1] is not None and start <= now[1]:
                out.append((*key, arrival, start, value, now[1], now[0], "stale"))
            else:
                out.append((*key, *now[:3], start, arrival, now[3]))
                now = arrival, start, value, "superseded"
        yield batch_of(out)
    if now is not None:
        yield batch_of([(*key, *now[:3], None, None, now[3])])


def outcomes(events: DataFrame, kept: DataFrame) -> DataFrame:
    """How many events of each source were inserted, superseded, late or changed nothing."""
    total = events.groupBy("source").agg(F.count("*").alias("n"))
    by = kept.groupBy("source").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "superseded", "stale")])
    return total.join(by, "source").withColumn("unchanged", F.col("n") - F.col("inserted") - F.col("superseded") - F.col("stale"))


def current(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("valid_to").isNull())


def as_of(facts: DataFrame, at: int) -> DataFrame:
    """The newest version of each key that is valid at a time; late rows may overlap older history."""
    live = facts.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return live.groupBy(*KEY).agg(F.max_by(F.struct("value", "valid_from"), F.struct("valid_from", "arrival")).alias("v")).select(*KEY, "v.value", "v.valid_from")


def with_acl(facts: DataFrame, acl: DataFrame) -> DataFrame:
    """Facts under the access rule their key has now: history follows it, whatever held then."""
    return facts.join(acl, KEY)


def retire_entity(facts: DataFrame, source: str, entity: str, at: int) -> DataFrame:
    """Closes all current facts of an entity."""
    own = (F.col("source") == source) & (F.col("entity_id") == entity) & F.col("valid_to").isNull()
    return facts.withColumn("valid_to", F.when(own, F.lit(at).cast("long")).otherwise(F.col("valid_to")))


def correct_acl(rows: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Rewrites access on all rows of the keys, history included; an un-share never lowers the class.

    corrections: keys, new_visibility, new_confidentiality (null: unchanged).
    """
    out = rows.join(corrections, keys, "left")
    return out.withColumn("visibility", F.coalesce("new_visibility", "visibility")).withColumn("confidentiality", F.greatest("confidentiality", "new_confidentiality")).drop("new_visibility", "new_confidentiality")


def precedence(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the source order of (canonical, field): its own, else ('*', field), (canonical, '*'), ('*', '*')."""
    levels = [("canonical", "field"), (None, "field"), ("canonical", None), (None, None)]
    out = fields
    for k, (c, f) in enumerate(levels):
        own = rules.where((F.col("rule_canonical") != "*" if c else F.col("rule_canonical") == "*") & (F.col("rule_field") != "*" if f else F.col("rule_field") == "*")).select(F.col("rule_canonical").alias("rc"), F.col("rule_field").alias("rf"), F.col("source_order").alias(f"o{k}"))
        on = [F.col("canonical") == F.col("rc")] * bool(c) + [F.col("field") == F.col("rf")] * bool(f)
        out = (out.join(own, on, "left") if on else out.crossJoin(own.groupBy().agg(F.first("rc").alias("rc"), F.first("rf").alias("rf"), F.first(f"o{k}").alias(f"o{k}")))).drop("rc", "rf")
    return out.withColumn("source_order", F.coalesce(*[f"o{k}" for k in range(4)])).drop(*[f"o{k}" for k in range(4)])


def merged_record(facts: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """Per canonical and field the winning value and the others in order.

    facts: visible current facts; members: ref (source:entity_id), canonical.
    Ranked by the source's place in the order (unlisted last), newest first,
    then source and entity.
    """
    own = facts.withColumn("ref", F.concat_ws(":", "source", "entity_id")).join(members, "ref")
    own = precedence(own, rules)
    place = F.array_position(F.coalesce("source_order", F.array().cast("array<string>")), F.col("source"))
    rank = F.when(place > 0, place - 1).otherwise(F.coalesce(F.size("source_order"), F.lit(0)))
    rows = own.withColumn("rank", F.when(F.col("source_order").isNull(), F.lit(0)).otherwise(rank).cast("long"))
    order = F.array_sort(F.collect_list(F.struct("rank", (-F.col("valid_from")).alias("newest"), "source", "entity_id", "value")))
    return rows.groupBy("canonical", "field").agg(order.alias("o")).select("canonical", "field", F.col("o")[0]["value"].alias("value"), F.col("o")[0]["source"].alias("source"), (F.size("o") - 1).alias("n_alternatives"), F.array_join(F.transform(F.slice("o", 2, F.greatest(F.size("o") - 1, F.lit(0))), lambda x: F.concat(x["source"], F.lit("="), F.coalesce(x["value"], F.lit("")))), ";").alias("alternatives"))


def chunk_versions(deliveries: DataFrame) -> DataFrame:
    """Chunks as deliveries leave them: document_id, seq, delivery (number), valid_from, content, valid_to.

    A later delivery closes the same place's older version, and every place
    beyond the last it delivers (a document that shrank). A document's
    deliveries, two numbers each, travel as one sorted array with its chunks;
    the first that is later and shorter is found there, so rows never multiply.
    """
    per = deliveries.groupBy("document_id", "valid_from").agg(F.max("seq").alias("last"))
    history = per.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("valid_from", "last"))).alias("history"))
    place = Window.partitionBy("document_id", "seq").orderBy("valid_from")
    rows = deliveries.dropDuplicates(["document_id", "seq", "valid_from"]).withColumn("next_same", F.lead("valid_from").over(place)).join(history, "document_id")
    shrunk = F.get(F.filter("history", lambda h: (h["valid_from"] > F.col("valid_from")) & (h["last"] < F.col("seq"))), F.lit(0))["valid_from"]
    return rows.select("document_id", "seq", "valid_from", "content", F.least("next_same", shrunk).alias("valid_to"))


def retract_token(chunks: DataFrame, token: int) -> DataFrame:
    """Strips a token from every version; the class stays. affected marks changed rows."""
    return chunks.withColumn("affected", F.array_contains("visibility", token)).withColumn("visibility", F.array_remove("visibility", token))


def retire_document(chunks: DataFrame, source: str, document: int, at: int) -> DataFrame:
    """Closes a document's current chunks and hides them."""
    own = (F.col("source") == source) & (F.col("document_id") == document) & F.col("valid_to").isNull()
    return chunks.withColumn("visibility", F.when(own, F.array().cast("array<bigint>")).otherwise(F.col("visibility"))).withColumn("valid_to", F.when(own, F.lit(at).cast("long")).otherwise(F.col("valid_to")))


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the latest: how aliases, precedence, settings and tags are upserted."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")


def first_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the earliest: replays of an action or of evidence change nothing."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")
