"""Queries of lists, lookups and small life cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import bindings as b
from quarry.operators import access, reads, retrieval, service
from quarry.operators import directory as d
from quarry.operators import scope as sc
from quarry.operators import facts as fa
from quarry.plans.recall import _COS, QUERY, SCOPE, sql_scope
from quarry.session import table
from quarry.sources import connectors
from quarry.streaming import acl


def _principals(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS token", "'p:' || c_name AS principal")


def tokens_resolved(spark, sf):
    asked = table(spark, sf, "orders").selectExpr("o_orderkey AS token")
    return d.resolve(_principals(spark, sf), asked, "token")


def principals_resolved(spark, sf):
    asked = table(spark, sf, "supplier").selectExpr("'p:Customer#' || lpad(CAST(s_suppkey * 3 AS STRING), 9, '0') AS principal")
    return d.resolve(_principals(spark, sf), asked, "principal")


def principals_page(spark, sf):
    return d.principals_page(_principals(spark, sf), 40, 30)


def _audit(spark, sf):
    rows = b.actions(spark, sf).selectExpr("action_id AS read_id", "actor", "CASE WHEN action_id % 2 = 0 THEN 'recall' ELSE 'activity' END AS endpoint", "summary AS target", "visibility AS result_ids", "occurred_at AS at")
    return d.audit_rows(rows)


def audit_list(spark, sf):
    return d.newest(_audit(spark, sf), "at", "read_id", 60, actor="actor:3", endpoint="recall")


def knowledge_by_status(spark, sf):
    items = table(spark, sf, "documents").selectExpr("doc_id AS knowledge_id", "CASE doc_id % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'published' ELSE 'rejected' END AS status", f"{b.BASE} + doc_id * 7 % 1009 AS last_reinforced")
    return d.newest(items, "last_reinforced", "knowledge_id", 200, 200, status="published")


def evidence_of_refs(spark, sf):
    e = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "'cust:' || o_custkey AS left_ref", "'cust:' || (o_custkey * 7 % 1500) AS right_ref", "o_orderkey * 31 % 5003 AS valid_from", "CASE WHEN o_orderkey % 5 = 0 THEN 1L END AS valid_to")
    return d.live_evidence(e, spark.range(20, 40).selectExpr("'cust:' || id AS ref"))


def field_summaries(spark, sf):
    f = table(spark, sf, "events").selectExpr("event_type AS source", "'crm:user:' || user_id AS entity_id", "CASE event_id % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'domain' ELSE 'k' END AS field", "event_type || user_id || event_id % 3 AS value", "CASE WHEN event_id % 2 = 0 THEN 1L END AS valid_to").dropDuplicates(["source", "entity_id", "field", "valid_to"])
    members = table(spark, sf, "events").selectExpr("event_type || ':crm:user:' || user_id AS ref", "'canon:' || (user_id % 40) AS canonical").distinct()
    return d.field_summary(f, members)


def webhook_lookup(spark, sf):
    hooks = table(spark, sf, "customer").selectExpr("sha2('tok' || (c_custkey % 700), 256) AS token_hash", "c_name AS name", "CASE WHEN c_custkey % 3 = 0 THEN 1L END AS revoked_at")
    return hooks.sparkSession.range(1).select(F.sha2(F.lit("tok41"), 256).alias("h")).join(d.lookup(hooks.withColumn("h", F.col("token_hash")), "h", F.sha2(F.lit("tok41"), 256)), "h").select("name")


def tags_overwritten(spark, sf):
    tags = table(spark, sf, "documents").where("doc_id % 4 = 0").selectExpr("source", "doc_id div 3 AS document_id", "CAST(doc_id % 3 AS INT) AS seq", "array('grp:new', 'lang:' || lang) AS new_tags")
    return d.overwrite_tags(b.chunks(spark, sf), tags)[0].select("id", F.array_join("tags", ",").alias("tags"), "hit")


def briefs_staled(spark, sf):
    tags = table(spark, sf, "documents").where("doc_id % 4 = 0").selectExpr("source", "doc_id div 3 AS document_id", "CAST(doc_id % 3 AS INT) AS seq", "array('grp:' || doc_id % 50, 'lang:' || lang) AS new_tags")
    return d.overwrite_tags(b.chunks(spark, sf), tags)[1]


def tags_appended(spark, sf):
    s = table(spark, sf, "documents").where("doc_id % 2 = 0").selectExpr("doc_id AS id", "'lang:' || CASE WHEN doc_id % 6 = 0 THEN lang ELSE 'xx' END AS entity")
    return d.append_tag(b.chunks(spark, sf), s.unionByName(s.where("id % 8 = 0").withColumn("entity", F.lit("a:first")))).select("id", F.array_join("tags", ",").alias("tags"))


def quarantine_lifecycle(spark, sf):
    items = table(spark, sf, "customer").selectExpr("c_custkey AS id")
    r = table(spark, sf, "orders").selectExpr("o_custkey AS id", "o_orderkey AS at", "CASE o_orderkey % 5 WHEN 0 THEN 'dismiss' WHEN 1 THEN 'failed' ELSE 'reingest' END AS action", "CASE WHEN o_orderkey % 3 = 0 THEN array(o_custkey % 7) END AS visibility")
    return d.quarantine_after(items, r).groupBy("status").agg(F.count("*").alias("n"), F.sum("refused").alias("refused"), F.sum("resolved_at").alias("at"))


_POST = "CASE o_orderkey % 7 WHEN 0 THEN '{not json' WHEN 1 THEN '{\"other\":1}' WHEN 2 THEN '{\"content\":\"x\",\"visibility\":[' || (o_orderkey % 4) || ']}' WHEN 3 THEN '{\"observation\":\"y\",\"entities\":[\"e' || (o_orderkey % 3) || '\"]}' WHEN 4 THEN '{\"facts\":{\"a\":\"b\"}}' ELSE '{\"content\":\"z\"}' END"


def webhook_deliveries(spark, sf):
    posts = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "'t' || (o_custkey % 6) AS token", f"{_POST} AS body")
    hooks = spark.range(5).selectExpr("sha2('t' || id, 256) AS token_hash", "array(0L, 1L, 2L) AS visibility", "CASE WHEN id % 2 = 0 THEN array('e0', 'e1') ELSE CAST(array() AS array<string>) END AS entities", "CASE WHEN id = 4 THEN 1L END AS revoked_at")
    return d.webhook_deliveries(posts, hooks)


def connector_status(spark, sf):
    batches = table(spark, sf, "orders").selectExpr("o_orderpriority AS source", "o_orderkey AS at", "CASE WHEN o_orderkey % 4 = 0 THEN 'c' || o_orderkey END AS cursor", "o_orderkey % 50 AS items", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 60 END AS last_event_at")
    return d.connector_status(batches)


def entity_directory(spark, sf):
    tags = reads.entity_tags(b.chunks(spark, sf), b.actions(spark, sf), "a").select("entity", "chunks", "actions")
    aliases = table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("'user:' || c_custkey AS ref", "'canon:' || (c_custkey div 4) AS canonical")
    badges = aliases.where("canonical LIKE '%1'").withColumn("confidence", F.lit("deterministic"))
    return d.entity_directory(tags, aliases, badges, 120)


def access_corpus_with_facts(spark, sf):
    rows = d.corpus_rows(b.chunks(spark, sf), fa.current(b.fact_events(spark, sf).withColumn("valid_to", F.lit(None).cast("long"))), SCOPE)
    return access.corpus(rows, "a")


def embedding_route(spark, sf):
    """A tenant's own value before the one for all: nulls last."""
    rows = table(spark, sf, "nation").selectExpr("CASE WHEN n_nationkey % 5 <> 0 THEN 't' || (n_nationkey % 6) END AS tenant", "'embedding_route' AS name", "'v' || n_nationkey AS value", "n_nationkey AS at")
    return service.settings(fa.last_write(rows, ["tenant", "name"], "at").drop("at"), spark.range(8).selectExpr("'t' || id AS tenant"))


def episodes_sealed(spark, sf):
    """Payloads encrypted on append and opened again, with the hash they were appended under."""
    key = b"0123456789abcdef"
    rows = d.sealed(table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS episode_id", "text AS payload"), key)
    return d.opened(rows, key).select("episode_id", "content_hash", (F.sha2("payload", 256) == F.col("content_hash")).alias("intact"))


def knowledge_near(spark, sf):
    items = b.vectors(spark, sf).selectExpr("id", "embedding", "CASE id % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'published' ELSE 'rejected' END AS status", "array('c' || (id % 4)) AS categories")
    return retrieval.near_knowledge(items, QUERY, ["c1", "c2"], -0.2, 8)


def latency_percentiles(spark, sf):
    return service.latency(table(spark, sf, "events").selectExpr("event_type AS operation", "value AS ms"))


def metric_gauges(spark, sf):
    q = table(spark, sf, "events").selectExpr("event_id AS id", "CASE WHEN event_id % 3 = 0 THEN value END AS resolved_at")
    return service.gauges(q, table(spark, sf, "orders").selectExpr("CASE WHEN o_orderkey % 10 = 0 THEN 'degraded' ELSE 'ok' END AS state"))


def acl_changes(spark, sf):
    seen = table(spark, sf, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS record", "array('u:' || c_custkey % 5, 'g:1') AS principals")
    batch = table(spark, sf, "orders").selectExpr("o_custkey AS record", "array('u:' || o_custkey % 4, 'g:1') AS principals", "o_orderkey AS at")
    return acl.acl_lane(seen, batch)[0].select("record", F.array_join("removed", ",").alias("removed"), F.array_join("added", ",").alias("added"))


def retractions_open(spark, sf):
    parked = table(spark, sf, "customer").where("c_custkey % 4 = 0").selectExpr("c_custkey AS record")
    attempts = table(spark, sf, "orders").selectExpr("o_custkey AS record", "o_orderkey % 6 = 0 AS ok")
    return acl.retraction_ledger(parked, attempts)


def document_gates(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 11 = 0 AS removed", "CASE WHEN o_orderkey % 5 <> 0 THEN array('u') END AS envelope", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(array() AS array<bigint>) ELSE array(1L) END AS tokens")
    return o.select("id", connectors.document_gate(F.col("removed"), F.col("envelope"), F.col("tokens")).alias("gate"))


def mail_organisations(spark, sf):
    a = table(spark, sf, "customer").selectExpr("'x' || c_custkey || '@mail.firm' || (c_custkey % 60) || '.co.uk' AS address")
    return connectors.org_facts(a, ["firm7.co.uk"])


def recording_audience(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'internally' ELSE 'publicly' END AS setting", "'Host' || c_custkey || '@acme.com' AS host", "CASE WHEN c_custkey % 2 = 0 THEN 'ACME.com' ELSE 'other.de' END AS domain")
    return c.select("c_custkey", connectors.audience(F.col("setting"), F.col("host"), F.col("domain"), "acme.com").alias("audience"))


def slack_channels(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "named_struct('is_im', c_custkey % 7 = 0, 'is_shared', c_custkey % 5 = 0, 'is_ext_shared', CASE WHEN c_custkey % 11 = 0 THEN true END, 'is_private', c_custkey % 3 = 0, 'is_channel', c_custkey % 2 = 0) AS ch")
    return c.select("c_custkey", connectors.channel_class(F.col("ch")).alias("lane"))


def slack_threads(spark, sf):
    m = table(spark, sf, "events").selectExpr("'ch' || (user_id % 4) AS channel", "event_id AS ts", "CASE WHEN event_id % 3 <> 0 THEN event_id div 20 * 20 END AS thread_ts", "CASE WHEN event_id % 2 = 0 THEN '' ELSE 'Ann' END AS display_name", "CASE WHEN event_id % 4 = 0 THEN 'Bo' END AS real_name", "'U' || user_id AS user", "event_type AS text")
    t = connectors.thread_documents(m)
    return t.select("channel", "thread_ts", F.sha2("content", 256).alias("sha"))


def purpose_scoped(spark, sf):
    """What a purpose and revocations leave of a scope, by what it still sees."""
    tomb = spark.createDataFrame([(2, b.BASE + 5), (11, b.BASE - 5)], "token long, at long")
    gone = spark.createDataFrame([(3,)], "token long")
    own = sc.compile_scope(sc.Scope("a", (1, 2, 3, 11), ceiling=3, issued_at=b.BASE), tomb, gone, sc.Purpose(1))
    return sc.scoped_chunks(b.chunks(spark, sf), own).select("id", "confidentiality")


QUERIES = {q.__name__: q for q in (tokens_resolved, principals_resolved, principals_page, audit_list, knowledge_by_status, evidence_of_refs, field_summaries, webhook_lookup, tags_overwritten, briefs_staled, tags_appended, quarantine_lifecycle, webhook_deliveries, connector_status, entity_directory, access_corpus_with_facts, embedding_route, episodes_sealed, knowledge_near, latency_percentiles, metric_gauges, acl_changes, retractions_open, document_gates, mail_organisations, recording_audience, slack_channels, slack_threads, purpose_scoped)}

_P = "p AS (SELECT c_custkey AS token, 'p:' || c_name AS principal FROM customer)"
ORACLE_SQL = {
    "tokens_resolved": f"WITH {_P} SELECT token, principal FROM p WHERE token IN (SELECT o_orderkey FROM orders)",
    "principals_resolved": f"WITH {_P} SELECT token, principal FROM p WHERE principal IN (SELECT 'p:Customer#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') FROM supplier)",
    "principals_page": f"WITH {_P} SELECT token, principal FROM p WHERE token > 40 ORDER BY token LIMIT 30",
    "audit_list": b.sql("actions", then=" SELECT action_id AS read_id, actor, 'recall' AS endpoint, sha256(summary) AS target_hash, CAST(len(visibility) AS INT) AS n_results, occurred_at AS at FROM actions WHERE actor = 'actor:3' AND action_id % 2 = 0 ORDER BY occurred_at DESC, action_id DESC LIMIT 60"),
    "knowledge_by_status": f"SELECT doc_id AS knowledge_id, 'published' AS status, {b.BASE} + doc_id * 7 % 1009 AS last_reinforced FROM documents WHERE doc_id % 3 = 1 ORDER BY last_reinforced DESC, doc_id DESC LIMIT 200",
    "evidence_of_refs": "WITH e AS (SELECT o_orderkey AS id, o_custkey AS l, o_custkey * 7 % 1500 AS r, o_orderkey * 31 % 5003 AS valid_from FROM orders WHERE o_orderkey % 5 <> 0) SELECT id, 'cust:' || l AS left_ref, 'cust:' || r AS right_ref, valid_from, CAST(NULL AS BIGINT) AS valid_to FROM e WHERE l BETWEEN 20 AND 39 OR r BETWEEN 20 AND 39",
    "field_summaries": "WITH f AS (SELECT DISTINCT event_type AS source, user_id, event_id % 3 AS f FROM events WHERE event_id % 2 = 1), n AS (SELECT 'canon:' || (user_id % 40) AS canonical, f, arg_min(source || user_id || f, source || '|crm:user:' || user_id) AS v FROM f WHERE f < 2 GROUP BY ALL) SELECT canonical, max(v) FILTER (f = 0) AS name, max(v) FILTER (f = 1) AS domain FROM n GROUP BY canonical",
    "webhook_lookup": "SELECT c_name AS name FROM customer WHERE c_custkey % 700 = 41 AND c_custkey % 3 <> 0",
    "tags_overwritten": b.sql("chunks", then=" SELECT id, array_to_string(CASE WHEN id % 4 = 0 AND valid_to IS NULL THEN ['grp:new', 'lang:' || lang] ELSE tags END, ',') AS tags, id % 4 = 0 AND valid_to IS NULL AS hit FROM chunks JOIN documents ON id = doc_id"),
    "briefs_staled": b.sql("chunks", then=" SELECT 'grp:' || id % 50 AS entity FROM chunks WHERE id % 4 = 0 AND valid_to IS NULL UNION SELECT 'lang:' || lang FROM chunks JOIN documents ON id = doc_id WHERE id % 4 = 0 AND valid_to IS NULL"),
    "tags_appended": b.sql("chunks", then=", m AS (SELECT id, tags, CASE WHEN id % 8 = 0 THEN ['a:first', 'lang:' || CASE WHEN id % 6 = 0 THEN lang ELSE 'xx' END] WHEN id % 2 = 0 THEN ['lang:' || CASE WHEN id % 6 = 0 THEN lang ELSE 'xx' END] ELSE CAST([] AS VARCHAR[]) END AS more FROM chunks JOIN documents ON id = doc_id) SELECT id, array_to_string(list_concat(tags, list_filter(more, lambda x: NOT list_contains(tags, x))), ',') AS tags FROM m"),
    "webhook_deliveries": """WITH p AS (SELECT o_orderkey AS id, o_custkey % 6 AS t, o_orderkey % 7 AS k, o_orderkey % 4 AS v, o_orderkey % 3 AS e FROM orders),
s AS (SELECT *, CASE WHEN t >= 4 THEN 'unknown_hook' WHEN k = 0 THEN 'quarantined_shape' WHEN k = 1 THEN 'quarantined_empty' WHEN k = 2 AND v = 3 THEN 'forbidden_visibility' WHEN k = 3 AND t % 2 = 0 AND e = 2 THEN 'forbidden_entities' ELSE 'accepted' END AS status FROM p)
SELECT id, status, CASE WHEN status = 'accepted' THEN CASE WHEN k = 2 THEN CAST(v AS VARCHAR) ELSE '0,1,2' END END AS visibility, CASE WHEN status = 'accepted' THEN CASE WHEN k = 3 THEN 'e' || e WHEN t % 2 = 0 THEN 'e0,e1' ELSE '' END END AS entities FROM s""",
    "connector_status": "SELECT o_orderpriority AS source, arg_max('c' || o_orderkey, o_orderkey) FILTER (o_orderkey % 4 = 0) AS cursor, CAST(sum(o_orderkey % 50) AS BIGINT) AS items_synced, max(o_orderkey * 60) FILTER (o_orderkey % 3 = 0) AS last_event_at, max(o_orderkey) AS updated_at FROM orders GROUP BY 1",
    "entity_directory": b.sql("chunks", "actions", then=""", u AS (SELECT unnest(tags) AS entity, 1 AS c, 0 AS a FROM chunks WHERE tenant = 'a' UNION ALL SELECT unnest(entities), 0, 1 FROM actions WHERE tenant = 'a'), t AS (SELECT entity, CAST(sum(c) AS BIGINT) AS chunks, CAST(sum(a) AS BIGINT) AS actions FROM u GROUP BY 1),
al AS (SELECT 'user:' || c_custkey AS entity, 'canon:' || (c_custkey // 4) AS canonical FROM customer WHERE c_custkey % 2 = 0)
SELECT entity, chunks, actions, canonical, CASE WHEN canonical LIKE '%1' THEN 'deterministic' END AS confidence FROM t LEFT JOIN al USING (entity) ORDER BY chunks + actions DESC, entity LIMIT 120"""),
    "access_corpus_with_facts": b.sql("chunks", "fact_events", then=f""", r AS (SELECT source, confidentiality, 'doc:' || document_id AS d FROM chunks WHERE {sql_scope(SCOPE)} UNION ALL SELECT source, confidentiality, source || ':' || entity_id || ':' || field FROM fact_events WHERE {sql_scope(SCOPE, current=False)})
SELECT 'all' AS lane, '' AS key, count(*) AS n_rows, count(DISTINCT (source, d)) AS n_documents FROM r UNION ALL SELECT 'source', source, count(*), count(DISTINCT (source, d)) FROM r GROUP BY source UNION ALL SELECT 'confidentiality', CAST(confidentiality AS VARCHAR), count(*), count(DISTINCT (source, d)) FROM r GROUP BY confidentiality"""),
    "embedding_route": "WITH r AS (SELECT CASE WHEN n_nationkey % 5 <> 0 THEN 't' || (n_nationkey % 6) END AS tenant, arg_max('v' || n_nationkey, n_nationkey) AS value FROM nation GROUP BY 1), t AS (SELECT 't' || unnest(range(8)) AS tenant) SELECT t.tenant, 'embedding_route' AS name, coalesce(o.value, d.value) AS value FROM t LEFT JOIN r o ON o.tenant = t.tenant LEFT JOIN r d ON d.tenant IS NULL",
    "episodes_sealed": "SELECT conv_id * 1000 + turn AS episode_id, sha256(text) AS content_hash, sha256(text) IS NOT NULL AS intact FROM conversations",
    "knowledge_near": b.sql("vectors", then=f" SELECT id, {_COS} AS score FROM vectors WHERE id % 3 <> 2 AND id % 4 IN (1, 2) AND {_COS} >= -0.2 ORDER BY score DESC, id LIMIT 8"),
    "latency_percentiles": """WITH e AS (SELECT event_type AS operation, round(value / 0.1::DOUBLE) * 0.1::DOUBLE AS ms FROM events WHERE value IS NOT NULL), c AS (SELECT *, count(*) OVER (PARTITION BY operation) AS n, count(*) OVER (PARTITION BY operation ORDER BY ms) AS upto FROM e)
SELECT operation, max(n) AS n, round(min(ms) FILTER (upto >= 0.5 * n), 6) AS p50, round(min(ms) FILTER (upto >= 0.95 * n), 6) AS p95, round(min(ms) FILTER (upto >= 0.99 * n), 6) AS p99 FROM c GROUP BY 1""",
    "metric_gauges": "SELECT 'quarantine_depth' AS gauge, count(*) FILTER (event_id % 3 <> 0 OR value IS NULL) AS n FROM events UNION ALL SELECT 'degraded_runs', count(*) FILTER (o_orderkey % 10 = 0) FROM orders",
    "acl_changes": "WITH b AS (SELECT DISTINCT o_custkey AS r FROM orders), p AS (SELECT r, r % 4 AS n, CASE WHEN r IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) THEN r % 5 END AS o FROM b) SELECT r AS record, CASE WHEN o <> n THEN 'u:' || o ELSE '' END AS removed, CASE WHEN o IS NULL THEN 'g:1,u:' || n WHEN o <> n THEN 'u:' || n ELSE '' END AS added FROM p WHERE o IS NULL OR o <> n",
    "retractions_open": "SELECT record FROM (SELECT c_custkey AS record FROM customer WHERE c_custkey % 4 = 0 UNION SELECT o_custkey FROM orders) WHERE record NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 6 = 0)",
    "document_gates": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'retire' WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'quarantine' ELSE 'mirror' END AS gate FROM orders",
    "mail_organisations": "SELECT DISTINCT 'firm' || (c_custkey % 60) || '.co.uk' AS domain FROM customer WHERE c_custkey % 60 <> 7",
    "recording_audience": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'user:host' || c_custkey || '@acme.com' WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'domain:acme.com' ELSE 'quarantine' END AS audience FROM customer",
    "slack_channels": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'skip' WHEN c_custkey % 5 = 0 OR c_custkey % 11 = 0 THEN 'quarantine' WHEN c_custkey % 3 = 0 THEN 'members' WHEN c_custkey % 2 = 0 THEN 'workspace' ELSE 'quarantine' END AS lane FROM customer",
    "slack_threads": "WITH m AS (SELECT 'ch' || (user_id % 4) AS channel, event_id AS ts_n, CASE WHEN event_id % 3 <> 0 THEN event_id // 20 * 20 ELSE event_id END AS thread_ts, CASE WHEN event_id % 2 = 1 THEN 'Ann' WHEN event_id % 4 = 0 THEN 'Bo' ELSE 'U' || user_id END || ': ' || event_type AS line FROM events) SELECT channel, thread_ts, sha256(string_agg(line, chr(10) ORDER BY ts_n)) AS sha FROM m GROUP BY 1, 2",
    "purpose_scoped": b.sql("chunks", then=" SELECT id, confidentiality FROM chunks WHERE tenant = 'a' AND confidentiality <= 1 AND list_has_any(visibility, [1, 11]) AND valid_to IS NULL"),
}
