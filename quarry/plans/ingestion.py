"""Queries of the ingestion plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import canon
from quarry.sources import cdc, connectors, documents, manifest
from quarry.session import table

_ACL = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ',\"acl\":{\"visibility\":\"all\"}' ELSE ',\"acl\":{\"visibility\":[' || (o_orderkey % 7) || ',9],\"confidentiality\":\"' || CASE WHEN o_orderkey % 8 = 3 THEN 'Secret' ELSE 'Confidential' END || '\"}' END"
_INNER = "'{\"op\":\"' || CASE o_orderkey % 5 WHEN 0 THEN 'd' WHEN 1 THEN 'c' ELSE 'u' END || '\",\"source\":{\"connector\":\"pg\",\"db\":\"crm\",\"schema\":\"s\",\"table\":\"t' || (o_orderkey % 3) || '\",\"ts_ms\":' || (1700000000000 + o_orderkey * 1000) || '},\"before\":{\"id\":' || o_orderkey || '},\"after\":{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\",\"prio\":\"' || o_orderpriority || '\"}' || " + _ACL + " || '}'"
BODY = f"CASE WHEN o_orderkey % 2 = 0 THEN '{{\"payload\":' || {_INNER} || '}}' ELSE {_INNER} END"


def _events(spark, sf):
    return cdc.parse_envelopes(table(spark, sf, "orders").select(F.col("o_orderkey").alias("arrival"), F.expr(BODY).alias("body")))


def debezium_parse(spark, sf):
    return _events(spark, sf).select("arrival", "op", "source", "entity_id", "ts_ms", F.array_join("visibility", ",").alias("visibility"), "confidentiality")


def debezium_facts(spark, sf):
    return cdc.to_facts(_events(spark, sf)).select("arrival", "source", "entity_id", "field", "value", "valid_from")


def cdc_counters(spark, sf):
    return cdc.counters(_events(spark, sf))


PAYLOAD = "'{\"type\":\"' || CASE WHEN o_orderkey % 3 = 0 THEN 'Issue' ELSE 'Note' END || '\",\"data\":{' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '\"id\":\"I' || o_orderkey || '\",' END || '\"state\":{\"name\":\"' || o_orderstatus || '\"},\"updatedAt\":\"2024-01-02\"},\"acl\":[' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '{\"p\":\"u' || (o_orderkey % 9) || '\"}' END || ']}'"
MANIFEST = manifest.Manifest("tracker", "type = Issue and data.state.name != X", "data.id", "data.updatedAt", {"state": "data.state.name", "missing": "data.nope"}, principals="acl[].p")


def _applied(spark, sf):
    return manifest.apply(MANIFEST, table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(PAYLOAD).alias("body")))


def manifest_apply(spark, sf):
    return _applied(spark, sf)[0].select("id", "entity_id", "field", "value", "valid_from", F.array_join("principals", ",").alias("principals"))


def manifest_quarantine(spark, sf):
    return _applied(spark, sf)[1]


def split_chunks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return documents.split_documents(docs).select("id", "seq", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha"))


def share_principals(spark, sf):
    shares = table(spark, sf, "orders").selectExpr("o_orderkey AS record", "CASE o_orderkey % 3 WHEN 0 THEN '005' || (o_custkey % 200) WHEN 1 THEN '00G' || (o_custkey % 20) ELSE '00E1' END AS grantee")
    roster = table(spark, sf, "customer").selectExpr("'005' || c_custkey AS user_id", "c_custkey % 4 <> 0 AS active", "CASE WHEN c_custkey % 5 <> 0 THEN 'Fed' || c_custkey END AS federation_id")
    return connectors.share_principals(shares, roster)


def mail_participants(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "'Jane <Jane' || (c_custkey % 40) || '@Acme' || (c_custkey % 3) || '.com>, bob@Firm.de' AS h1", "CASE WHEN c_custkey % 2 = 0 THEN 'BOB@firm.de; x' || c_custkey || '@gmail.com' END AS h2")
    return c.select("c_custkey", F.array_join(connectors.participants(F.col("h1"), F.col("h2")), ",").alias("participants"))


def mail_dedup(spark, sf):
    m = table(spark, sf, "lineitem").selectExpr("CASE WHEN l_orderkey % 3 = 0 THEN 'm' || l_orderkey ELSE ' ' END AS message_id", "'th' || (l_orderkey % 100) AS thread_id", "l_linenumber AS sent_at", "l_orderkey * 10 + l_linenumber AS mailbox")
    return connectors.mail_dedup(m).select("dedup_key", "mailbox")


def crm_facts(spark, sf):
    r = table(spark, sf, "customer").selectExpr("c_custkey AS id", "map('name', c_name, 'segment', CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'owner_id', CAST(c_custkey % 30 AS STRING), 'created', 'x') AS properties", "c_custkey * 60 AS updated_at")
    owners = table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS owner_id", "'user:' || s_suppkey AS principals")
    return connectors.crm_facts(r, ["created", "owner_id"], owners)


def rolling_captions(spark, sf):
    c = table(spark, sf, "events").selectExpr("user_id AS meeting", "event_id AS at", "CASE WHEN event_id % 8 < 6 THEN 'a' ELSE 'b' END AS speaker", "repeat('word ', CAST(1 + event_id % 4 AS INT)) AS text")
    return connectors.captions(c)


QUERIES = {q.__name__: q for q in (debezium_parse, debezium_facts, cdc_counters, manifest_apply, manifest_quarantine, split_chunks, share_principals, mail_participants, mail_dedup, crm_facts, rolling_captions)}

_O = f"""e AS (SELECT o_orderkey AS arrival, o_orderkey, o_orderstatus, o_orderpriority, CAST({BODY} AS JSON) AS j FROM orders),
p AS (SELECT *, CASE WHEN json_exists(j, '$.payload') THEN json_extract(j, '$.payload') ELSE j END AS p FROM e),
x AS (SELECT arrival, CASE WHEN p->>'$.op' = 'd' THEN 'delete' ELSE 'upsert' END AS op, (p->>'$.source.connector') || ':' || (p->>'$.source.db') || '.' || (p->>'$.source.schema') || '.' || (p->>'$.source.table') AS source,
  CASE WHEN p->>'$.op' = 'd' THEN p->>'$.before.id' ELSE p->>'$.after.id' END AS entity_id, CAST(p->>'$.source.ts_ms' AS BIGINT) AS ts_ms,
  json_type(p, '$.acl.visibility') = 'ARRAY' AND coalesce(lower(p->>'$.acl.confidentiality'), 'internal') IN ('public', 'internal', 'confidential', 'restricted') AS ok, p FROM p)"""
ORACLE_SQL = {
    "debezium_parse": f"WITH {_O} SELECT arrival, op, source, entity_id, ts_ms, CASE WHEN ok THEN array_to_string(CAST(json_extract(p, '$.acl.visibility') AS BIGINT[]), ',') END AS visibility, CASE WHEN ok THEN 2 END AS confidentiality FROM x",
    "debezium_facts": f"WITH {_O} SELECT arrival, source, entity_id, 'status' AS field, p->>'$.after.status' AS value, ts_ms // 1000 AS valid_from FROM x WHERE op = 'upsert' AND ok UNION ALL SELECT arrival, source, entity_id, 'prio', p->>'$.after.prio', ts_ms // 1000 FROM x WHERE op = 'upsert' AND ok",
    "cdc_counters": f"WITH {_O} SELECT source, count(*) AS events, CAST(sum(CASE WHEN op = 'upsert' AND ok THEN 2 ELSE 0 END) AS BIGINT) AS taken, CAST(sum(CASE WHEN op = 'upsert' AND ok IS NOT TRUE THEN 2 ELSE 0 END) AS BIGINT) AS refused, count(*) FILTER (op = 'delete') AS deleted FROM x GROUP BY source",
    "manifest_apply": "SELECT o_orderkey AS id, 'I' || o_orderkey AS entity_id, 'state' AS field, o_orderstatus AS value, '2024-01-02' AS valid_from, 'u' || (o_orderkey % 9) AS principals FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderstatus <> 'X'",
    "manifest_quarantine": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 OR o_orderstatus = 'X' THEN 'unrouted' WHEN o_orderkey % 7 = 0 THEN 'no_key' ELSE 'no_acl' END AS reason FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderstatus = 'X'",
    "share_principals": "WITH s AS (SELECT o_orderkey AS record, o_orderkey % 3 AS k, o_custkey FROM orders) SELECT DISTINCT record, 'fed' || c_custkey AS principal FROM s JOIN customer ON c_custkey = o_custkey % 200 WHERE k = 0 AND c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 UNION ALL SELECT record, 'group:00G' || (o_custkey % 20) FROM s WHERE k = 1",
    "mail_participants": "SELECT c_custkey, 'jane' || (c_custkey % 40) || '@acme' || (c_custkey % 3) || '.com,bob@firm.de' || CASE WHEN c_custkey % 2 = 0 THEN ',x' || c_custkey || '@gmail.com' ELSE '' END AS participants FROM customer",
    "mail_dedup": "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'm' || l_orderkey ELSE 'th' || (l_orderkey % 100) || '|' || l_linenumber END AS dedup_key, min(l_orderkey * 10 + l_linenumber) AS mailbox FROM lineitem GROUP BY 1",
    "crm_facts": "WITH r AS (SELECT c_custkey AS id, 'name' AS field, c_name AS value, c_custkey % 30 AS o FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment, c_custkey % 30 FROM customer WHERE c_custkey % 3 <> 0) SELECT id, field, value, id * 60 AS valid_from, CASE WHEN s_suppkey IS NOT NULL THEN 'user:' || s_suppkey END AS principals FROM r LEFT JOIN supplier ON s_suppkey = o",
    "rolling_captions": "WITH c AS (SELECT user_id AS meeting, event_id AS at_n, CASE WHEN event_id % 8 < 6 THEN 'a' ELSE 'b' END AS speaker, repeat('word ', CAST(1 + event_id % 4 AS INT)) AS text FROM events), n AS (SELECT *, lead(text) OVER w AS nt, lead(speaker) OVER w AS ns FROM c WINDOW w AS (PARTITION BY meeting ORDER BY at_n)) SELECT meeting, at_n AS at, speaker, text FROM n WHERE NOT coalesce(ns = speaker AND starts_with(nt, text), false)",
}
