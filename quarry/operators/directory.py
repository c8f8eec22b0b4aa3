"""Lists, lookups and small life cycles: principals, audit, evidence, tags, quarantine, webhooks, connectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.reads import clamp
from quarry.operators.scope import Scope, scoped


def resolve(principals: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """(token, principal) of what is asked by either column; what is not known is absent."""
    return principals.select("token", "principal").join(asked.select(by).distinct(), by, "left_semi")


def principals_page(principals: DataFrame, after: int, limit: int) -> DataFrame:
    return principals.where(F.col("token") > after).orderBy("token").limit(clamp(limit, 1000)).select("token", "principal")


def newest(rows: DataFrame, at: str, ident: str, limit: int, most: int = 500, **equal) -> DataFrame:
    """The newest rows, of those whose columns have given values: how audit, quarantine and retirements are listed."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc(at), F.desc(ident)).limit(clamp(limit, most))


def audit_rows(reads: DataFrame) -> DataFrame:
    """What is written for each read (read_id, actor, endpoint, target, result_ids, at): appended, never changed; who
    asked what and how many rows came back, and not what they hold."""
    return reads.select("read_id", "actor", "endpoint", F.sha2("target", 256).alias("target_hash"), F.size("result_ids").alias("n_results"), "at")


def live_evidence(evidence: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Evidence that still holds, of some refs on either side or of all, oldest first."""
    rows = evidence.where("valid_to IS NULL")
    if refs is not None:
        own = refs.select("ref").distinct()
        left = rows.join(own.withColumnRenamed("ref", "left_ref"), "left_ref", "left_semi").select(*evidence.columns)
        # those found by both sides come once
        right = rows.join(own.withColumnRenamed("ref", "right_ref"), "right_ref", "left_semi").join(own.withColumnRenamed("ref", "left_ref"), "left_ref", "left_anti").select(*evidence.columns)
        rows = left.unionByName(right)
    return rows.orderBy("valid_from", "id")


def field_summary(facts: DataFrame, members: DataFrame, fields: tuple[str, ...] = ("name", "domain")) -> DataFrame:
    """Per canonical the first value of each field among its members' current facts, by source and entity.

    members: ref, canonical. Matched on source:entity_id as one text, since sources may hold a colon.
    """
    own = facts.where(F.col("valid_to").isNull() & F.col("field").isin(*fields)).withColumn("ref", F.concat_ws(":", "source", "entity_id")).join(members, "ref")
    first = lambda f: F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.struct("source", "entity_id"))).alias(f)
    return own.groupBy("canonical").agg(*[first(f) for f in fields])


def lookup(rows: DataFrame, key: str, value, revoked: str | None = "revoked_at") -> DataFrame:
    """The row of a key, unless it is revoked."""
    found = rows.where(F.col(key) == value)
    return found.where(F.col(revoked).isNull()) if revoked else found


def canonical_of(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """ref and canonical: an unmapped ref is its own."""
    return refs.join(aliases.select("ref", "canonical"), "ref", "left").select("ref", F.coalesce("canonical", "ref").alias("canonical"))


def overwrite_tags(chunks: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, stale entities): current chunks of (source, document_id, seq) get a whole new set of tags.

    tags: source, document_id, seq, new_tags. Briefs of the new tags' entities are stale then.
    """
    key = ["source", "document_id", "seq"]
    rows = chunks.join(tags, key, "left").withColumn("hit", F.col("valid_to").isNull() & F.col("new_tags").isNotNull())
    stale = rows.where("hit").select(F.explode("new_tags").alias("entity")).distinct()
    return rows.withColumn("tags", F.when(F.col("hit"), F.col("new_tags")).otherwise(F.col("tags"))).select(*chunks.columns, "hit"), stale


def append_tag(chunks: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Chunks with approved tags (id, entity) added where they lack; an added tag stands last."""
    own = suggestions.select("id", "entity").distinct().groupBy("id").agg(F.array_sort(F.collect_list("entity")).alias("more"))
    rows = chunks.join(own, "id", "left")
    return rows.withColumn("tags", F.when(F.col("more").isNotNull(), F.concat("tags", F.array_except("more", "tags"))).otherwise(F.col("tags"))).drop("more")


def quarantine_after(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Quarantined items (id) after requests (id, at, action, visibility): the first that counts settles an item.

    Taking an item in again needs an explicit access rule; dismissing needs
    none. ``failed`` reopens an item that its taking in did not survive. A
    settled item takes no second resolution: status, resolved_at, visibility.
    """
    ordered = F.array_sort(F.collect_list(F.struct("at", "action", "visibility")))
    state = "struct<status:string,resolved_at:bigint,visibility:array<bigint>,refused:int>"
    start = F.struct(F.lit("open"), F.lit(None).cast("bigint"), F.lit(None).cast("array<bigint>"), F.lit(0)).cast(state)
    settle = lambda s, r, to, v: F.struct(F.lit(to), r["at"], v, s["refused"]).cast(state)
    none = F.lit(None).cast("array<bigint>")

    def step(s: Column, r: Column) -> Column:
        is_open = s["status"] == "open"
        ruled = F.coalesce(F.size(r["visibility"]), F.lit(0)) > 0
        refused = F.struct(s["status"], s["resolved_at"], s["visibility"], s["refused"] + 1).cast(state)
        reopened = F.struct(F.lit("open"), F.lit(None).cast("bigint"), none, s["refused"]).cast(state)
        return (
            F.when(is_open & (r["action"] == "dismiss"), settle(s, r, "dismissed", none))
            .when(is_open & (r["action"] == "reingest") & ruled, settle(s, r, "reingested", r["visibility"]))
            .when((s["status"] == "reingested") & (r["action"] == "failed"), reopened)
            .otherwise(refused)
        )

    folded = requests.groupBy("id").agg(F.aggregate(ordered, start, step).alias("s"))
    rows = items.select("id").join(folded, "id", "left")
    return rows.select("id", F.coalesce("s.status", F.lit("open")).alias("status"), F.col("s.resolved_at").alias("resolved_at"), F.col("s.visibility").alias("visibility"), F.coalesce("s.refused", F.lit(0)).alias("refused"))


PAYLOAD = "content string, observation string, facts map<string,string>, visibility array<bigint>, entities array<string>"


def webhook_deliveries(posts: DataFrame, hooks: DataFrame) -> DataFrame:
    """What becomes of posts (id, token, body): unknown hook, quarantined, refused, or taken with what it may be seen by.

    hooks: token_hash, visibility, entities, revoked_at. A body that is no JSON
    object of the known shape, or says nothing, is kept for triage. A body may
    narrow the hook's visibility and entities and never widen them.
    """
    known = hooks.where("revoked_at IS NULL").select("token_hash", F.col("visibility").alias("bound"), F.col("entities").alias("fence"))
    b = F.from_json("body", PAYLOAD + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = posts.select("id", F.sha2("token", 256).alias("token_hash"), b.alias("b")).join(known, "token_hash", "left")
    broken = F.col("b").isNull() | F.col("b._corrupt_record").isNotNull()
    silent = F.col("b.content").isNull() & F.col("b.observation").isNull() & (F.coalesce(F.size("b.facts"), F.lit(0)) <= 0)
    asked = F.coalesce("b.entities", F.array().cast("array<string>"))
    wider = F.col("b.visibility").isNotNull() & (F.size(F.array_except("b.visibility", "bound")) > 0)
    outside = (F.size("fence") > 0) & (F.size(F.array_except(asked, "fence")) > 0)
    status = F.when(F.col("bound").isNull(), "unknown_hook").when(broken, "quarantined_shape").when(silent, "quarantined_empty").when(wider, "forbidden_visibility").when(outside, "forbidden_entities").otherwise("accepted")
    entities = F.when((F.size("fence") > 0) & (F.size(asked) == 0), F.col("fence")).otherwise(asked)
    said = lambda c: F.when(status == "accepted", F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return rows.select("id", status.alias("status"), said(F.coalesce("b.visibility", "bound")).alias("visibility"), said(entities).alias("entities"))


def connector_status(batches: DataFrame) -> DataFrame:
    """Per source: the cursor last reported, items in all, the newest event and report (source, at, cursor, items, last_event_at)."""
    return batches.groupBy("source").agg(F.max_by("cursor", F.when(F.col("cursor").isNotNull(), F.col("at"))).alias("cursor"), F.sum("items").alias("items_synced"), F.max("last_event_at").alias("last_event_at"), F.max("at").alias("updated_at"))


def entity_directory(tags: DataFrame, aliases: DataFrame, badges: DataFrame, limit: int) -> DataFrame:
    """Tags (entity, chunks, actions) with the canonical they belong to and how sure that is, busiest first."""
    rows = tags.join(aliases.select(F.col("ref").alias("entity"), "canonical"), "entity", "left").join(badges.select(F.col("ref").alias("entity"), "canonical", "confidence"), ["entity", "canonical"], "left")
    return rows.select("entity", "chunks", "actions", "canonical", "confidence").orderBy(F.desc(F.col("chunks") + F.col("actions")), "entity").limit(limit)


def corpus_rows(chunks: DataFrame, facts: DataFrame | None, scope: Scope) -> DataFrame:
    """Rows of the access corpus: chunks a scope sees and, where asked, facts, whose key is their document."""
    own = scoped(chunks, scope).select("tenant", "source", "confidentiality", F.concat(F.lit("doc:"), "document_id").alias("document_id"))
    if facts is None:
        return own
    return own.unionByName(scoped(facts, scope).select("tenant", "source", "confidentiality", F.concat_ws(":", "source", "entity_id", "field").alias("document_id")))


def sealed(episodes: DataFrame, key: bytes) -> DataFrame:
    """Episodes to append: a hash of the payload and, in its place, the payload encrypted (AES-GCM)."""
    return episodes.withColumn("content_hash", F.sha2("payload", 256)).withColumn("sealed", F.aes_encrypt(F.encode("payload", "UTF-8"), F.lit(key))).drop("payload")


def opened(episodes: DataFrame, key: bytes) -> DataFrame:
    return episodes.withColumn("payload", F.decode(F.aes_decrypt("sealed", F.lit(key)), "UTF-8")).drop("sealed")
