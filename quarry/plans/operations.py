"""Queries of knowledge, lineage, erasure and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import bindings as b
from quarry.operators import facts as f
from quarry.operators import knowledge as k
from quarry.operators import service as s
from quarry.session import table

EV = "event_id % 97 AS knowledge_id, event_id AS episode_id, CASE WHEN event_id % 5 <> 0 THEN 'user:' || (user_id % (1 + event_id % 97 % 14)) END AS entity, 'w' || (user_id % 3) AS writer, CAST(1 + event_id % 2 AS INT) AS trust_tier"


def _evidence(spark, sf):
    return spark.sql(f"SELECT {EV} FROM {{e}}", e=table(spark, sf, "events"))


_STATUS = "CASE knowledge_id % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'eligible' WHEN 2 THEN 'published' ELSE 'rejected' END"


def knowledge_support(spark, sf):
    return k.support(_evidence(spark, sf)).withColumn("tier", k.support_tier(F.col("entities")))


def publish_gate(spark, sf):
    items = k.support(_evidence(spark, sf)).withColumn("status", F.expr(_STATUS)).withColumn("visibility", F.expr("CASE WHEN knowledge_id % 10 = 0 THEN CAST(array() AS array<bigint>) ELSE array(1L) END"))
    return k.promoted(k.publish_gate(items)).select("knowledge_id", "refused", "status")


def deid_gate(spark, sf):
    statements = b.chunks(spark, sf).selectExpr("id", "content AS statement")
    lexicon = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term"))
    return k.identifying(statements, lexicon)


def forget_cascade(spark, sf):
    ev = _evidence(spark, sf)
    items = k.support(ev).withColumn("status", F.lit("published"))
    facts = ev.selectExpr("episode_id", "CAST(NULL AS BIGINT) AS valid_to")
    out = k.forget_episodes(ev.where("episode_id % 2 = 0 OR knowledge_id % 9 = 0"), facts, ev, items, b.BASE)
    return out["items"].groupBy("status").agg(F.count("*").alias("n"), F.sum("entities").alias("entities"))


def derived_visibility(spark, sf):
    chunks = b.chunks(spark, sf).withColumn("provenance", F.col("id") + 1_000_000)
    writes = table(spark, sf, "labels").selectExpr("doc_id AS write_id", "CASE WHEN doc_id % 6 = 0 THEN CAST(array() AS array<bigint>) WHEN doc_id % 6 = 1 THEN array(doc_id, doc_id + 21 + 1000000) WHEN doc_id % 6 = 2 THEN array(doc_id, 99999999L) ELSE array(doc_id) END AS refs", "CASE WHEN doc_id % 4 = 0 THEN array(1L, 3L, 11L) END AS declared")
    return k.derived_visibility(writes, chunks)


def _episodes(spark, sf):
    """Conversation turns, each whole behind sentences that state facts."""
    return table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS episode_id", "concat('Acme Corp is ', substr(text, 1, 12), '. Customers in ', role, ' always pay late! Plan: ', substr(text, 1, 9), '\nOwner: team ', conv_id % 7, '.\nhttp link: x\nNothing here.\n', text) AS content", "array('crm:acct' || (conv_id % 9)) AS entities")


def extract_l2_facts(spark, sf):
    return k.l2_facts(_episodes(spark, sf)).withColumn("predicate", k.predicate(F.col("relation")))


def knowledge_candidates(spark, sf):
    return k.candidates(_episodes(spark, sf))


SUBJECT = "actor:7"


ENTITY = "user:9"


def _support_rows(spark, sf):
    """Evidence of which the last seven items have little: most of theirs speaks for others."""
    return _evidence(spark, sf).withColumn("knowledge_id", F.expr("CASE WHEN knowledge_id < 90 OR episode_id % 20 = 7 OR episode_id < 300 THEN knowledge_id ELSE knowledge_id - 90 END"))


def _tables(spark, sf):
    """The tables that an erasure walks, derived from the actions and documents."""
    actions = b.actions(spark, sf).withColumn("provenance", F.col("action_id") * 2)
    e = table(spark, sf, "events")
    return {
        "episodes": b.actions(spark, sf).selectExpr("action_id AS episode_id", "actor AS writer", "CASE WHEN action_id % 6 = 0 THEN entities[0] END AS entity"),
        "actions": actions.select("action_id", "actor", "entities", "summary", "provenance"),
        "chunks": b.chunks(spark, sf).selectExpr("id", "id * 3 AS provenance", "CASE WHEN id % 40 = 0 THEN array_append(tags, 'user:9') ELSE tags END AS tags", "CASE WHEN kind = 'knowledge' THEN 'knowledge:' || (id div 17) ELSE 'd' || document_id END AS document_id", "valid_to"),
        "facts": b.fact_events(spark, sf).selectExpr("arrival AS fact_id", "entity_id", "value", "arrival AS provenance", "CASE WHEN arrival % 3 = 0 THEN arrival + 1 END AS superseded_by"),
        "evidence": _support_rows(spark, sf),
        "items": k.support(_support_rows(spark, sf)).selectExpr("knowledge_id", "entities", "evidence", "CASE WHEN knowledge_id % 4 = 1 THEN 'candidate' ELSE 'published' END AS status"),
        "quarantine": e.selectExpr("event_id AS id", "CASE WHEN event_id % 5 = 0 THEN '{\"who\":\"Actor:' || (user_id % 20) || '\"}' ELSE '{\"of\":\"user:' || user_id || '\"}' END AS payload"),
        "audit": e.selectExpr("event_id AS id", "'actor:' || (event_id % 20) AS actor"),
        "media": e.selectExpr("event_id AS id"),
    }


def _erased(spark, sf):
    return k.erasure(_tables(spark, sf), b.BASE, SUBJECT, ENTITY, (3, 5, 99999999))


def erasure_preview(spark, sf):
    return k.erasure_preview(_erased(spark, sf)[0])


def erasure_survivors(spark, sf):
    """What is left: rows of every table, pointers that are left in facts, chunks still current, support of items."""
    left = _erased(spark, sf)[1]
    rows = k.erasure_preview(left)
    extra = k.erasure_preview({"facts_linked": left["facts"].where("superseded_by IS NOT NULL"), "chunks_current": left["chunks"].where("valid_to IS NULL"), "items_published": left["items"].where("status = 'published'")})
    return rows.unionByName(extra)


def erasure_items(spark, sf):
    return _erased(spark, sf)[1]["items"]


def erasure_record(spark, sf):
    return k.erasure_record(_erased(spark, sf)[0], b.BASE, "admin", SUBJECT, ENTITY)


def subject_export(spark, sf):
    removed = k.erasure(_tables(spark, sf), b.BASE, SUBJECT)[0]
    return k.subject_export({n: removed[n] for n in ("episodes", "actions", "chunks", "facts", "audit")})


#: A window that begins and ends within the samples.
SLO_NOW, SLO_WINDOW = b.BASE - 9000 * b.DAY, 90 * b.DAY


def slo_freshness(spark, sf):
    return s.freshness(b.samples(spark, sf), SLO_NOW, SLO_WINDOW)


UPDATES = "event_id % 60 AS run, event_id AS at, CASE WHEN event_id % 3 = 0 THEN 'src' || (event_id % 60 % 7) END AS source, CASE WHEN event_id % 4 = 0 THEN event_type END AS state, CASE WHEN event_id % 5 = 0 THEN event_id % 1000 END AS total, event_id % 11 AS delta"


def backfill_latest(spark, sf):
    return s.latest_per_source(s.backfill_progress(spark.sql(f"SELECT {UPDATES} FROM {{e}}", e=table(spark, sf, "events"))))


SETTINGS = "CASE WHEN n_nationkey >= 5 THEN 't' || (n_nationkey % 4) END AS tenant, 'set' || (n_nationkey % 6) AS name, n_name AS value, n_nationkey AS at"


def settings_resolve(spark, sf):
    rows = f.last_write(spark.sql(f"SELECT {SETTINGS} FROM {{n}} WHERE n_nationkey < 5 OR n_nationkey % 3 = 0", n=table(spark, sf, "nation")), ["tenant", "name"], "at").drop("at")
    return s.settings(rows, spark.range(5).selectExpr("'t' || id AS tenant"))


def coverage(spark, sf):
    return s.coverage(b.chunks(spark, sf), b.vectors(spark, sf))


def lease_queue(spark, sf):
    e = table(spark, sf, "events")
    episodes = e.selectExpr("event_id AS episode_id", "CASE event_id % 4 WHEN 0 THEN 'observation' WHEN 1 THEN 'webhook' WHEN 2 THEN 'doc_version' ELSE 'action' END AS kind", f"{b.SECONDS.format('ts')} AS recorded_at")
    leases = e.where("event_id % 3 = 0").selectExpr("event_id AS episode_id", f"{b.BASE} + event_id * 60 AS leased_until")
    return s.lease(episodes, leases, e.where("event_id % 5 = 0").selectExpr("event_id AS episode_id"), b.BASE + 3 * b.DAY, 200)


def work_completed(spark, sf):
    e = table(spark, sf, "events")
    leases = e.where("event_id % 3 = 0").selectExpr("event_id % 2000 AS episode_id", "'w' || (user_id % 3) AS worker", "event_id * 60 + 3600 AS leased_until")
    reports = e.where("event_id % 4 < 2").selectExpr("event_id % 2000 AS episode_id", "'w' || (event_id % 3) AS worker", "event_id * 61 AS at").dropDuplicates(["episode_id", "worker", "at"])
    return s.complete(spark.range(0, 2000, 7).withColumnRenamed("id", "episode_id"), leases, reports, 10**9)


THRESHOLDS = [i / 20 for i in range(21)]


def eval_threshold_sweep(spark, sf):
    return s.threshold_sweep(table(spark, sf, "labels").selectExpr("(doc_id * 7919 % 1000) / 1000.0D AS score", "quality = 1 AS truth"), THRESHOLDS)


def schema_drift(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "filter(array('id', 'name', CASE WHEN o_orderkey % 3 = 0 THEN 'extra' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'owner' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'acl' END, CASE WHEN o_orderkey % 2 = 0 THEN 'etag' END), x -> x IS NOT NULL) AS keys")
    return s.schema_drift(rows, ["id", "name", "owner"], ["acl"], ["etag"])


def transcript_turns(spark, sf):
    return s.turns(table(spark, sf, "conversations"))


QUERIES = {q.__name__: q for q in (knowledge_support, publish_gate, deid_gate, forget_cascade, derived_visibility, extract_l2_facts, knowledge_candidates, erasure_preview, erasure_survivors, erasure_items, erasure_record, subject_export, slo_freshness, backfill_latest, settings_resolve, coverage, lease_queue, work_completed, eval_threshold_sweep, schema_drift, transcript_turns)}

_SUP = f"ev AS (SELECT {EV} FROM events), sup AS (SELECT knowledge_id, count(DISTINCT entity) AS entities, count(*) AS evidence, count(DISTINCT writer) AS writers, bool_or(trust_tier = 1) AS has_tier1 FROM ev GROUP BY 1)"
_READY = "status = 'candidate' AND entities >= 3 AND (writers >= 2 OR has_tier1)"
_EP = "ep AS (SELECT conv_id * 1000 + turn AS episode_id, concat('Acme Corp is ', substr(text, 1, 12), '. Customers in ', role, ' always pay late! Plan: ', substr(text, 1, 9), chr(10), 'Owner: team ', conv_id % 7, '.', chr(10), 'http link: x', chr(10), 'Nothing here.', chr(10), text) AS content, ['crm:acct' || (conv_id % 9)] AS entities FROM conversations)"


def _erase(entity: bool) -> str:
    """The tables of an erasure and what it removes: of the subject, and of the entity where asked."""
    of = f"'{ENTITY}'" if entity else "NULL"
    return f""", ent AS (SELECT {of} AS e), {_SUP.split(", sup AS")[0]}, evi AS (SELECT * REPLACE (CASE WHEN knowledge_id < 90 OR episode_id % 20 = 7 OR episode_id < 300 THEN knowledge_id ELSE knowledge_id - 90 END AS knowledge_id) FROM ev),
ep AS (SELECT action_id AS episode_id, actor AS writer, CASE WHEN action_id % 6 = 0 THEN entities[1] END AS entity FROM actions),
act AS (SELECT action_id, actor, entities, summary, action_id * 2 AS provenance, actor = '{SUBJECT}' OR coalesce(list_contains(entities, e), false) AS who FROM actions, ent),
ids AS (SELECT episode_id FROM ep, ent WHERE writer = '{SUBJECT}' OR entity = e UNION SELECT provenance FROM act WHERE who),
ch AS (SELECT id, id * 3 AS provenance, CASE WHEN id % 40 = 0 THEN list_append(tags, 'user:9') ELSE tags END AS tags, CASE WHEN kind = 'knowledge' THEN 'knowledge:' || (id // 17) ELSE 'd' || document_id END AS document_id, valid_to FROM chunks),
ch2 AS (SELECT ch.*, provenance IN (FROM ids) OR coalesce(list_contains(tags, e), false) AS gone FROM ch, ent),
fa AS (SELECT arrival AS fact_id, entity_id, value, arrival AS provenance, CASE WHEN arrival % 3 = 0 THEN arrival + 1 END AS superseded_by FROM fact_events),
fa2 AS (SELECT fa.*, provenance IN (FROM ids) OR coalesce(entity_id = e, false) AS gone FROM fa, ent),
evi2 AS (SELECT *, episode_id IN (FROM ids) AS gone FROM evi),
items AS (SELECT knowledge_id, count(DISTINCT entity) AS entities, count(*) AS evidence, count(DISTINCT entity) FILTER (NOT gone) AS now_entities, count(*) FILTER (NOT gone) AS now_evidence, bool_or(gone) AS touched, CASE WHEN knowledge_id % 4 = 1 THEN 'candidate' ELSE 'published' END AS was FROM evi2 GROUP BY knowledge_id),
after_items AS (SELECT knowledge_id, CASE WHEN touched THEN now_entities ELSE entities END AS entities, CASE WHEN touched THEN now_evidence ELSE evidence END AS evidence, touched AND was = 'published' AND now_entities < 3 AS falls, CASE WHEN touched AND was = 'published' AND now_entities < 3 THEN 'invalidated' ELSE was END AS status FROM items),
qu AS (SELECT lower(CASE WHEN event_id % 5 = 0 THEN '{{"who":"Actor:' || (user_id % 20) || '"}}' ELSE '{{"of":"user:' || user_id || '"}}' END) AS payload FROM events),
qu2 AS (SELECT contains(payload, '{SUBJECT}') OR coalesce(contains(payload, e), false) AS gone FROM qu, ent),
flags AS (SELECT 'actions' AS "table", who AS gone FROM act UNION ALL SELECT 'chunks', gone FROM ch2 UNION ALL SELECT 'facts', gone FROM fa2 UNION ALL SELECT 'knowledge_evidence', gone FROM evi2 UNION ALL SELECT 'quarantine', gone FROM qu2
  UNION ALL SELECT 'audit', event_id % 20 = 7 FROM events UNION ALL SELECT 'media', event_id IN (3, 5) FROM events UNION ALL SELECT 'episodes', episode_id IN (FROM ids) FROM ep),
removed AS (SELECT "table", count(*) FILTER (gone) AS n FROM flags GROUP BY 1 UNION ALL SELECT 'knowledge_invalidated', count(*) FILTER (falls) FROM after_items),
remain AS (SELECT "table", count(*) FILTER (NOT gone) AS n FROM flags GROUP BY 1 UNION ALL SELECT 'items', count(*) FROM after_items UNION ALL SELECT 'items_published', count(*) FILTER (status = 'published') FROM after_items
  UNION ALL SELECT 'facts_linked', count(*) FROM fa2 WHERE NOT gone AND superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT fact_id FROM fa2 WHERE gone)
  UNION ALL SELECT 'chunks_current', count(*) FROM ch2 WHERE NOT gone AND valid_to IS NULL AND document_id NOT IN (SELECT 'knowledge:' || knowledge_id FROM after_items WHERE falls))"""


# a mark behind each sentence end that white space follows, as RE2 has no look-behind
_SENT = "sent AS (SELECT episode_id, trim(unnest(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))) AS s FROM ep)"
_IS_SQL = "^([A-Z][\\w''-]*(?:\\s+[A-Z0-9][\\w''-]*){0,3})\\s+is\\s+(.{2,})$"
_PAIR_SQL = "^([A-Za-z][A-Za-z0-9 _/-]{0,48}):\\s+(\\S.*)$"
ORACLE_SQL = {
    "knowledge_support": f"WITH {_SUP} SELECT *, CASE WHEN entities >= 10 THEN 'extensive' WHEN entities >= 5 THEN 'established' WHEN entities >= 3 THEN 'emerging' END AS tier FROM sup",
    "publish_gate": f"WITH {_SUP}, i AS (SELECT *, {_STATUS} AS status FROM sup) SELECT knowledge_id, CASE WHEN knowledge_id % 10 = 0 THEN 'visibility_empty' WHEN status NOT IN ('candidate', 'eligible') THEN 'status' WHEN entities < 3 THEN 'k_support' WHEN NOT (writers >= 2 OR has_tier1) THEN 'corroboration' END AS refused, CASE WHEN {_READY} THEN 'eligible' ELSE status END AS status FROM i",
    # a statement's own first word in order is a term that it holds, so none behind that need be tried
    "deid_gate": b.sql("chunks", then=""", lex AS MATERIALIZED (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents),
own AS MATERIALIZED (SELECT id, lower(content) AS s, list_min(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4)) AS m FROM chunks)
SELECT id, min(term) AS term FROM own JOIN (FROM lex WHERE length(term) >= 4) ON term <= coalesce(m, chr(1114111)) AND contains(s, term) GROUP BY id"""),
    "forget_cascade": f"WITH {_SUP}, gone AS (SELECT * FROM ev WHERE episode_id % 2 = 0 OR knowledge_id % 9 = 0), l AS (SELECT knowledge_id, count(DISTINCT entity) AS e FROM ev WHERE episode_id NOT IN (SELECT episode_id FROM gone) GROUP BY 1), a AS (SELECT knowledge_id, CASE WHEN knowledge_id IN (SELECT knowledge_id FROM gone) THEN coalesce(e, 0) ELSE entities END AS entities, CASE WHEN knowledge_id IN (SELECT knowledge_id FROM gone) AND coalesce(e, 0) < 3 THEN 'invalidated' ELSE 'published' END AS status FROM sup LEFT JOIN l USING (knowledge_id)) SELECT status, count(*) AS n, CAST(sum(entities) AS BIGINT) AS entities FROM a GROUP BY status",
    "derived_visibility": b.sql("chunks", then=""", w AS (SELECT doc_id AS write_id, CASE WHEN doc_id % 6 = 0 THEN CAST([] AS BIGINT[]) WHEN doc_id % 6 = 1 THEN [doc_id, doc_id + 21 + 1000000] WHEN doc_id % 6 = 2 THEN [doc_id, 99999999] ELSE [doc_id] END AS refs, CASE WHEN doc_id % 4 = 0 THEN [1, 3, 11] END AS declared FROM labels),
r AS (SELECT write_id, unnest(refs) AS ref FROM w), f AS (SELECT DISTINCT write_id, ref, id, visibility, confidentiality FROM r JOIN chunks ON ref = id OR ref = id + 1000000),
g AS (SELECT write_id, count(DISTINCT ref) AS resolved, list_reduce(list(visibility), lambda x, y: list_intersect(x, y)) AS shared, max(confidentiality) AS class FROM f GROUP BY 1),
z AS (SELECT w.*, g.*, len(refs) > 0 AND coalesce(resolved, 0) < len(refs) AS bad FROM w LEFT JOIN g USING (write_id))
SELECT write_id, CASE WHEN bad THEN 'refused' WHEN declared IS NOT NULL THEN 'declared' WHEN len(refs) > 0 THEN 'derived' ELSE 'writer-scoped' END AS label,
CASE WHEN NOT bad THEN coalesce(array_to_string(list_sort(CASE WHEN len(refs) > 0 AND declared IS NOT NULL THEN list_intersect(shared, declared) WHEN len(refs) > 0 THEN shared WHEN declared IS NOT NULL THEN declared ELSE CAST([] AS BIGINT[]) END), ','), '') END AS visibility, CASE WHEN NOT bad THEN coalesce(class, 0) END AS confidentiality FROM z"""),
    "extract_l2_facts": f"""WITH {_EP}, {_SENT}, ln AS (SELECT episode_id, entities[1] AS subject, trim(unnest(string_split(content, chr(10)))) AS s FROM ep),
f AS (SELECT episode_id, regexp_extract(s, '{_IS_SQL}', 1) AS subject, 'is' AS relation, regexp_replace(regexp_extract(s, '{_IS_SQL}', 2), '[.!? ]+$', '') AS object FROM sent WHERE regexp_matches(s, '{_IS_SQL}')
UNION ALL SELECT episode_id, subject, trim(regexp_extract(s, '{_PAIR_SQL}', 1)), regexp_replace(regexp_extract(s, '{_PAIR_SQL}', 2), '[.!? ]+$', '') FROM ln WHERE regexp_matches(s, '{_PAIR_SQL}') AND NOT contains(lower(regexp_extract(s, '{_PAIR_SQL}', 1)), 'http'))
SELECT *, CASE WHEN relation = 'is' THEN 'is' ELSE trim(regexp_replace(lower(relation), '[^a-z0-9]+', '_', 'g'), '_') END AS predicate FROM f""",
    "knowledge_candidates": f"WITH {_EP}, {_SENT} SELECT DISTINCT episode_id, s AS statement FROM sent WHERE regexp_matches(s, '(?i)\\balways\\b|\\bconsistently\\b|\\bcustomers\\b.*\\btend\\b')",
    "erasure_preview": b.sql("chunks", "fact_events", "actions", then=f"{_erase(True)} SELECT * FROM removed"),
    "erasure_survivors": b.sql("chunks", "fact_events", "actions", then=f"{_erase(True)} SELECT * FROM remain"),
    "erasure_items": b.sql("chunks", "fact_events", "actions", then=f"{_erase(True)} SELECT knowledge_id, entities, evidence, status, CASE WHEN falls THEN 'erasure_support_withdrawn' END AS invalidated_reason FROM after_items"),
    "erasure_record": b.sql("chunks", "fact_events", "actions", then=f"{_erase(True)} SELECT 'admin' AS actor, 'erasure' AS endpoint, sha256('{SUBJECT}|{ENTITY}') AS target_hash, string_agg(\"table\" || '=' || n, ',' ORDER BY \"table\") AS counts, {b.BASE} AS at FROM removed"),
    "subject_export": b.sql("chunks", "fact_events", "actions", then=f"{_erase(False)} SELECT 'episodes' AS \"table\", to_json(x) AS body FROM (SELECT episode_id, writer, entity FROM ep WHERE episode_id IN (FROM ids)) x UNION ALL SELECT 'actions', to_json(x) FROM (SELECT * FROM act WHERE who) x0, LATERAL (SELECT action_id, actor, entities, summary, provenance) x UNION ALL SELECT 'chunks', to_json(x) FROM (SELECT id, provenance, tags, document_id, valid_to FROM ch WHERE provenance IN (FROM ids)) x UNION ALL SELECT 'facts', to_json(x) FROM (SELECT fact_id, entity_id, value, provenance, superseded_by FROM fa WHERE provenance IN (FROM ids)) x UNION ALL SELECT 'audit', to_json(x) FROM (SELECT event_id AS id, 'actor:' || (event_id % 20) AS actor FROM events WHERE event_id % 20 = 7) x"),
    "slo_freshness": b.sql("samples", then=f" SELECT source, count(*) AS n, round(quantile_cont((queryable_at - event_at)::DOUBLE, 0.5), 3) AS p50, round(quantile_cont((queryable_at - event_at)::DOUBLE, 0.95), 3) AS p95, round(quantile_cont((queryable_at - event_at)::DOUBLE, 0.99), 3) AS p99 FROM samples WHERE queryable_at > {SLO_NOW - SLO_WINDOW} AND queryable_at <= {SLO_NOW} GROUP BY source"),
    "settings_resolve": f"WITH r AS (SELECT tenant, name, arg_max(value, at_n) AS value FROM (SELECT {SETTINGS.replace(' AS at', ' AS at_n')} FROM nation WHERE n_nationkey < 5 OR n_nationkey % 3 = 0) GROUP BY ALL), t AS (SELECT 't' || unnest(range(5)) AS tenant), p AS (SELECT t.tenant, r.name FROM t, r WHERE r.tenant IS NULL OR r.tenant = t.tenant GROUP BY ALL) SELECT p.tenant, p.name, coalesce(o.value, d.value) AS value FROM p LEFT JOIN r o ON o.tenant = p.tenant AND o.name = p.name LEFT JOIN r d ON d.tenant IS NULL AND d.name = p.name",
    "backfill_latest": f"WITH u AS (SELECT {UPDATES.replace(' AS at,', ' AS at_n,')} FROM events), r AS (SELECT run, arg_max(source, at_n) FILTER (source IS NOT NULL) AS source, arg_max(state, at_n) FILTER (state IS NOT NULL) AS state, CAST(sum(delta) AS BIGINT) AS processed, max(at_n) AS updated_at FROM u GROUP BY run) SELECT source, run, state, processed, updated_at FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, run DESC) = 1",
    "coverage": b.sql("chunks", "vectors", then=" SELECT source, count(*) AS n, count(v.id) AS embedded, count(*) - count(v.id) AS missing FROM chunks c LEFT JOIN vectors v ON c.id = v.id WHERE valid_to IS NULL GROUP BY source"),
    "lease_queue": f"WITH e AS (SELECT event_id AS episode_id, CASE event_id % 4 WHEN 0 THEN 'observation' WHEN 1 THEN 'webhook' WHEN 2 THEN 'doc_version' ELSE 'action' END AS kind, {b._E.format('ts')} AS recorded_at, CASE WHEN event_id % 3 = 0 THEN {b.BASE} + event_id * 60 END AS leased FROM events) SELECT episode_id, kind, recorded_at FROM e WHERE kind <> 'action' AND episode_id % 5 <> 0 AND (leased IS NULL OR leased <= {b.BASE + 3 * b.DAY}) ORDER BY recorded_at, episode_id LIMIT 200",
    "work_completed": """WITH l AS (SELECT event_id % 2000 AS episode_id, 'w' || (user_id % 3) AS worker, max(event_id * 60 + 3600) AS until FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
r AS (SELECT DISTINCT event_id % 2000 AS episode_id, 'w' || (event_id % 3) AS worker, event_id * 61 AS at_s FROM events WHERE event_id % 4 < 2), j AS (SELECT r.*, coalesce(until > at_s, false) AS valid FROM r LEFT JOIN l USING (episode_id, worker)),
k AS (SELECT *, row_number() OVER (PARTITION BY episode_id, valid ORDER BY at_s, worker) AS place FROM j)
SELECT episode_id, worker, at_s AS at, CASE WHEN episode_id % 7 = 0 THEN 'repeat' WHEN NOT valid THEN 'no_lease' WHEN place = 1 THEN 'completed' ELSE 'repeat' END AS outcome FROM k WHERE at_s <= 1000000000""",
    "eval_threshold_sweep": f"WITH p AS (SELECT (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS score, quality = 1 AS truth FROM labels), t AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND truth) AS tp, count(*) FILTER (score >= threshold AND NOT truth) AS fp, count(*) FILTER (score < threshold AND truth) AS fn, count(*) FILTER (score < threshold AND NOT truth) AS tn FROM p CROSS JOIN t GROUP BY 1) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS false_merge_rate FROM c",
    "schema_drift": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'extra' ELSE '' END AS unknown, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'acl' END, CASE WHEN o_orderkey % 4 = 0 THEN 'owner' END) AS missing, o_orderkey % 5 = 0 AS quarantine FROM orders",
    "transcript_turns": "WITH a AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND lag(turn) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM a) SELECT conv_id, run, role, count(*) AS n, min(turn) AS first_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM r GROUP BY ALL",
}
