"""Change-data envelopes: parsing, inline access rules, facts and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.facts import versions

#: Fields of an envelope that hold no data.
RESERVED = ("acl",)


def _split(fields: str) -> list[str]:
    """The fields of a schema, those inside angle brackets left alone."""
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def parse_envelopes(raw: DataFrame, key: str = "id", acl_field: str = "acl") -> DataFrame:
    """Rows of raw JSON (arrival, body) as change events.

    An envelope stands bare or below ``payload``. Operations c, u and r upsert
    what ``after`` says, d deletes what ``before`` names. The source is
    connector:db.schema.table; the time is the source's, else the payload's,
    else null (the caller's clock). An access block that is malformed counts
    as none: nothing is ever seen by default.
    """
    parts = "op string, ts_ms string, before string, after string, source struct<connector:string,db:string,schema:string,table:string,ts_ms:string>, " + f"`{acl_field}` string"
    # the text is read once: its own fields and, where there is one, the payload's
    both = raw.select("arrival", F.from_json("body", f"payload struct<{', '.join(p.replace(' ', ':', 1) for p in _split(parts))}>, {parts}").alias("e"))
    b = both.select("arrival", *[F.coalesce(F.col(f"e.payload.{c}"), F.when(F.col("e.payload").isNull(), F.col(f"e.{c}"))).alias(c) for c in ("op", "ts_ms", "before", "after", "source", acl_field)])
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    fields = F.from_json(F.coalesce(row, F.lit("{}")), "map<string,string>")
    out = b.select("*", fields.alias("all")).select(
        "arrival",
        F.when(F.col("op").isin("c", "u", "r"), "upsert").when(F.col("op") == "d", "delete").alias("op"),
        F.concat(F.coalesce("source.connector", F.lit("cdc")), F.lit(":"), F.concat_ws(".", "source.db", "source.schema", "source.table")).alias("source"),
        F.col("all")[key].alias("entity_id"),
        F.coalesce("source.ts_ms", "ts_ms").cast("long").alias("ts_ms"),
        F.col("all").alias("fields"),
        F.from_json(acl_field, "struct<visibility:array<bigint>,confidentiality:string,acl_provenance:string>").alias("acl"),
    )
    level = F.lower("acl.confidentiality")
    rank = F.when(F.col("acl.confidentiality").isNull() | (level == "internal"), 1).when(level == "public", 0).when(level == "confidential", 2).when(level == "restricted", 3)
    good = F.col("acl.visibility").isNotNull() & ~F.exists("acl.visibility", lambda x: x.isNull()) & rank.isNotNull()
    return out.select("arrival", "op", "source", "entity_id", "ts_ms", F.map_filter("fields", lambda k, v: ~k.isin(key, *RESERVED)).alias("fields"), F.when(good, F.col("acl.visibility")).alias("visibility"), F.when(good, rank).alias("confidentiality"), F.when(good, F.coalesce("acl.acl_provenance", F.lit("mirrored"))).alias("acl_label"))


def bodies(raw: DataFrame) -> DataFrame:
    """Rows (arrival, body), of which a body may be an array of envelopes: one row each, numbered in order."""
    many = F.when(F.ltrim("body").startswith("["), F.from_json("body", "array<string>")).otherwise(F.array("body"))
    return raw.select(F.col("arrival").alias("delivery"), F.posexplode(many).alias("place", "body")).select((F.col("delivery") * 1_000_000 + F.col("place")).alias("arrival"), "body")


def changes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fact events, refusals): fields of upserts, and deletions as the end of every field that the entity ever has.

    An upsert without an access rule gives no fact; its fields are refused. A
    deletion needs none, as it shows nothing.
    """
    at = F.floor(F.col("ts_ms") / 1000).cast("long").alias("valid_from")
    rows = to_facts(events).withColumn("gone", F.lit(False))
    fields = rows.select("source", "entity_id", "field").distinct()
    ends = events.where("op = 'delete'").select("arrival", "source", "entity_id", at).join(fields, ["source", "entity_id"])
    ends = ends.select("arrival", "source", "entity_id", "field", F.lit(None).cast("string").alias("value"), "valid_from", F.lit(True).alias("gone"))
    refused = events.where("op = 'upsert' AND visibility IS NULL").select("arrival", "source", "entity_id", F.size("fields").alias("n_fields"))
    return rows.select(*ends.columns).unionByName(ends).withColumn("tenant", F.lit("a")), refused


def ingest(raw_stream: DataFrame, folder: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """The driver: every batch's envelopes are appended as they came and as parsed events.

    A batch writes folders of its own number, so one that runs again replaces
    what it wrote before; the fold over the log gives the versions.
    """

    def each(batch: DataFrame, number: int) -> None:
        raw = bodies(batch).persist()
        try:
            raw.withColumn("content_hash", F.sha2("body", 256)).write.mode("overwrite").parquet(f"{folder}/episodes/batch={number}")
            parse_envelopes(raw, key).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        finally:
            raw.unpersist()

    return raw_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_report(events: DataFrame) -> DataFrame:
    """What a run did, by source: fields inserted, superseded, late and unchanged, versions retired, fields refused."""
    facts, refused = changes(events)
    kept = versions(facts).groupBy("source").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "superseded", "stale")], F.count_if(F.col("valid_to").isNotNull() & F.col("superseded_by").isNull()).alias("retired"))
    total = facts.where("NOT gone").groupBy("source").agg(F.count("*").alias("fields"))
    turned = refused.groupBy("source").agg(F.sum("n_fields").alias("refused"))
    rows = total.join(kept, "source").join(turned, "source", "left")
    return rows.select("source", "inserted", "superseded", "stale", (F.col("fields") - F.col("inserted") - F.col("superseded") - F.col("stale")).alias("unchanged"), "retired", F.coalesce("refused", F.lit(0)).alias("refused"))


def to_facts(events: DataFrame) -> DataFrame:
    """One fact event per field of an upsert that has an access rule; the others are refused."""
    # a filter on parsed columns would be pushed down and parse every text once more; a null map gives no field instead
    own = F.when((F.col("op") == "upsert") & F.col("visibility").isNotNull(), F.col("fields"))
    rows = events.select("arrival", "source", "entity_id", F.explode_outer(own).alias("field", "value"), F.floor(F.col("ts_ms") / 1000).cast("long").alias("valid_from"), "visibility", "confidentiality")
    return rows.where("field IS NOT NULL")


def counters(events: DataFrame) -> DataFrame:
    """Per source: events, fields taken and refused, deletions."""
    n = F.coalesce(F.size("fields"), F.lit(0))
    return events.groupBy("source").agg(F.count("*").alias("events"), F.sum(F.when((F.col("op") == "upsert") & F.col("visibility").isNotNull(), n).otherwise(0)).alias("taken"), F.sum(F.when((F.col("op") == "upsert") & F.col("visibility").isNull(), n).otherwise(0)).alias("refused"), F.count_if(F.col("op") == "delete").alias("deleted"))
