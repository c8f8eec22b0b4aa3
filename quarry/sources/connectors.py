"""Pure transforms of connectors: records to facts, grants to principals, mail and channel rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crm_facts(records: DataFrame, metadata: list[str], owners: DataFrame) -> DataFrame:
    """One fact per non-null property that is no metadata; access from the owner (owner_id -> principals), else none.

    records: id, properties (map), updated_at. A record whose owner is unknown
    has no principals, so it falls to administrators and never opens up.
    """
    rows = records.withColumn("owner_id", F.col("properties")["owner_id"]).join(owners, "owner_id", "left")
    facts = rows.select("id", "updated_at", "principals", F.explode("properties").alias("field", "value"))
    return facts.where(F.col("value").isNotNull() & ~F.col("field").isin(*metadata)).select("id", "field", "value", F.col("updated_at").alias("valid_from"), "principals")


def share_principals(shares: DataFrame, roster: DataFrame) -> DataFrame:
    """Share rows (record, grantee) to principals: active users by federation id, groups as such, others not at all."""
    users = roster.where("active AND federation_id IS NOT NULL").select(F.col("user_id").alias("grantee"), F.lower("federation_id").alias("user_principal"))
    rows = shares.join(users, "grantee", "left")
    principal = F.when(F.col("grantee").startswith("005"), F.col("user_principal")).when(F.col("grantee").startswith("00G"), F.concat(F.lit("group:"), "grantee"))
    return rows.select("record", principal.alias("principal")).where("principal IS NOT NULL").distinct()


def drive_envelope(permissions: Column) -> Column:
    """Principals of a file's permissions (type, email, domain, role, deleted), or null: one unknown entry spoils all."""
    live = F.filter(permissions, lambda p: ~F.coalesce(p["deleted"], F.lit(False)))
    one = lambda p: F.when((p["type"] == "user") & p["email"].isNotNull(), F.concat(F.lit("user:"), F.lower(p["email"]))).when((p["type"] == "group") & p["email"].isNotNull(), F.concat(F.lit("group:"), F.lower(p["email"]))).when((p["type"] == "domain") & p["domain"].isNotNull(), F.concat(F.lit("domain:"), F.lower(p["domain"]))).when(p["type"] == "anyone", F.lit("anyone"))
    mapped = F.transform(live, one)
    return F.when(permissions.isNotNull() & (F.size(live) > 0) & ~F.exists(mapped, lambda x: x.isNull()), F.array_sort(F.array_distinct(mapped)))


def document_gate(removed: Column, envelope: Column, tokens: Column) -> Column:
    """What becomes of a document request."""
    return F.when(removed, "retire").when(envelope.isNull(), "quarantine").when(F.coalesce(F.size(tokens), F.lit(0)) == 0, "quarantine").otherwise("mirror")


ADDRESS = r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+"


def participants(*headers: Column) -> Column:
    """Addresses of headers, lower-cased, each once in order."""
    found = [F.regexp_extract_all(F.coalesce(h, F.lit("")), F.lit(f"({ADDRESS})"), F.lit(1)) for h in headers]
    return F.array_distinct(F.transform(F.concat(*found), lambda a: F.lower(a)))


def mail_dedup(messages: DataFrame) -> DataFrame:
    """One row per message seen in several mailboxes: by its Message-ID, else by thread and date; the first mailbox stays."""
    key = F.coalesce(F.nullif(F.trim("message_id"), F.lit("")), F.concat_ws("|", "thread_id", F.col("sent_at").cast("string")))
    rest = [c for c in messages.columns]
    return messages.withColumn("dedup_key", key).groupBy("dedup_key").agg(F.min_by(F.struct(*rest), "mailbox").alias("m")).select("dedup_key", "m.*")


def org_facts(addresses: DataFrame, own_domains: list[str]) -> DataFrame:
    """External registrable domains of addresses, each once."""
    from quarry.functions.canon import domain

    return addresses.select(domain(F.col("address")).alias("domain")).where(F.col("domain").isNotNull() & ~F.col("domain").isin(*own_domains, "")).distinct()


def channel_class(channel: Column) -> Column:
    """How a channel (struct with is_im, is_shared, is_ext_shared, is_private, is_channel) is treated."""
    shared = F.coalesce(channel["is_shared"], F.lit(False)) | F.coalesce(channel["is_ext_shared"], F.lit(False))
    return F.when(channel["is_im"], "skip").when(shared, "quarantine").when(channel["is_private"], "members").when(channel["is_channel"], "workspace").otherwise("quarantine")


def thread_documents(messages: DataFrame) -> DataFrame:
    """Threads as transcripts: channel, thread_ts, content (name: text per line, by time)."""
    name = F.coalesce(F.nullif("display_name", F.lit("")), F.nullif("real_name", F.lit("")), F.col("user"), F.lit("unknown"))
    lines = F.array_sort(F.collect_list(F.struct("ts", F.concat(name, F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return messages.groupBy("channel", F.coalesce("thread_ts", "ts").alias("thread_ts")).agg(lines.alias("l")).select("channel", "thread_ts", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def captions(cues: DataFrame) -> DataFrame:
    """Rolling captions (meeting, at, speaker, text): a cue that the next one of its speaker extends is dropped."""
    order = Window.partitionBy("meeting").orderBy("at")
    nxt, who = F.lead("text").over(order), F.lead("speaker").over(order)
    return cues.withColumn("grows", F.coalesce(who.eqNullSafe(F.col("speaker")) & nxt.startswith(F.col("text")), F.lit(False))).where("NOT grows").drop("grows")


def audience(setting: Column, host: Column, domain: Column, own_domain: str) -> Column:
    """Who sees a recording by its sharing setting."""
    return F.when(setting == "none", F.concat(F.lit("user:"), F.lower(host))).when((setting == "internally") & (F.lower(domain) == own_domain), F.lit(f"domain:{own_domain}")).otherwise(F.lit("quarantine"))
