"""Queries of facts and chunk versions through time."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import bindings as b
from quarry.operators import facts as f
from quarry.operators import scope as sc
from quarry.plans.recall import SCOPE, sql_scope

AT = b.BASE + 14 * b.DAY
NARROW = sc.Scope("a", (1, 2, 11), ceiling=2, entities=tuple(f"user:{i}" for i in range(0, 90, 3)))

# Current and past versions by the same state machine, as an ordered list fold.
_FOLD = """ev AS (SELECT tenant, source, entity_id, field, list({'arrival': arrival, 'valid_from': valid_from, 'value': value, 'valid_to': CAST(NULL AS BIGINT), 'superseded_by': CAST(NULL AS BIGINT), 'outcome': 'inserted'} ORDER BY arrival) AS es FROM fact_events GROUP BY ALL),
st AS (SELECT tenant, source, entity_id, field, list_reduce(list_transform(es, lambda e: [e]), lambda s, x:
  CASE WHEN s[1].value IS NOT DISTINCT FROM x[1].value THEN s
       WHEN x[1].valid_from <= s[1].valid_from THEN list_append(s, {'arrival': x[1].arrival, 'valid_from': x[1].valid_from, 'value': x[1].value, 'valid_to': s[1].valid_from, 'superseded_by': s[1].arrival, 'outcome': 'stale'})
       ELSE list_concat([{'arrival': x[1].arrival, 'valid_from': x[1].valid_from, 'value': x[1].value, 'valid_to': CAST(NULL AS BIGINT), 'superseded_by': CAST(NULL AS BIGINT), 'outcome': 'superseded'}],
         list_append(s[2:], {'arrival': s[1].arrival, 'valid_from': s[1].valid_from, 'value': s[1].value, 'valid_to': x[1].valid_from, 'superseded_by': x[1].arrival, 'outcome': s[1].outcome})) END) AS vs FROM ev),
facts AS MATERIALIZED (SELECT tenant, source, entity_id, field, v.arrival, v.valid_from, v.value, v.valid_to, v.superseded_by, v.outcome FROM (SELECT *, unnest(vs) AS v FROM st))"""
_ACL = "acl AS (SELECT DISTINCT tenant, source, entity_id, field, visibility, confidentiality FROM fact_events)"


def _facts(spark, sf):
    return f.versions(b.fact_events(spark, sf))


def _acl(spark, sf):
    return b.fact_events(spark, sf).select(*f.KEY, "visibility", "confidentiality").distinct()


def fact_state_machine(spark, sf):
    return _facts(spark, sf)


def fact_outcomes(spark, sf):
    return f.outcomes(b.fact_events(spark, sf), _facts(spark, sf))


def current_facts(spark, sf):
    return sc.scoped_facts(f.with_acl(_facts(spark, sf), _acl(spark, sf)), NARROW).select("source", "entity_id", "value", "valid_from")


def facts_as_of(spark, sf):
    seen = sc.scoped_facts(f.with_acl(_facts(spark, sf), _acl(spark, sf)), SCOPE, current=False)
    return f.as_of(seen, AT).select("source", "entity_id", "value", "valid_from")


def facts_retire_entity(spark, sf):
    return f.retire_entity(_facts(spark, sf), "view", "user:7", b.BASE + 60 * b.DAY).where(F.col("entity_id") == "user:7").select("source", "arrival", "valid_from", "valid_to")


def acl_correction_now_acl(spark, sf):
    fixes = b.fact_events(spark, sf).where("source = 'click'").select(*f.KEY).distinct().withColumn("new_visibility", F.array(F.lit(3).cast("long"))).withColumn("new_confidentiality", F.lit(1))
    rows = f.correct_acl(f.with_acl(_facts(spark, sf), _acl(spark, sf)), fixes, f.KEY)
    return f.as_of(sc.scoped_facts(rows, sc.Scope("a", (3,), 2), current=False), AT).select("source", "entity_id", "value")


def _deliveries(spark, sf):
    """Each document comes twice, the second time a day later and, for every other one, shorter."""
    c = b.chunks(spark, sf).selectExpr("document_id", "seq", "content", "document_id * 3600 AS valid_from")
    return c.unionByName(c.where("document_id % 2 = 0 OR seq < 2").selectExpr("document_id", "seq", "content || '!' AS content", f"valid_from + {b.DAY} AS valid_from"))


def chunk_versions(spark, sf):
    return f.chunk_versions(_deliveries(spark, sf)).select("document_id", "seq", "valid_from", "valid_to", F.length("content").alias("n"))


def retract_token(spark, sf):
    rows = f.retract_token(b.chunks(spark, sf), 11)
    return rows.groupBy("source").agg(F.count_if("affected").alias("rows_changed"), F.count_distinct(F.when(F.col("affected"), F.col("document_id"))).alias("documents"), F.sum(F.size("visibility")).alias("tokens_left"))


def retire_document(spark, sf):
    rows = f.retire_document(b.chunks(spark, sf), "src0", 4, b.BASE + 90 * b.DAY).where("document_id = 4")
    return rows.select("id", "source", F.size("visibility").alias("n_visible"), "valid_to")


MEMBERS = ("concat(source, ':', entity_id) AS ref", "'canon:' || (CAST(substr(entity_id, 6) AS BIGINT) % 40) AS canonical")
RULES = [("*", "*", ["click", "view"]), ("canon:3", "*", ["error"]), ("*", "k", ["purchase", "signup", "click"]), ("canon:5", "k", ["view", "error"])]


def merged_record(spark, sf):
    now = sc.scoped(f.with_acl(f.current(_facts(spark, sf)), _acl(spark, sf)), SCOPE)
    members = now.selectExpr(*MEMBERS).distinct()
    rules = spark.createDataFrame(RULES, "rule_canonical string, rule_field string, source_order array<string>")
    return f.merged_record(now, members, rules)


def actions_replayed(spark, sf):
    rows = b.actions(spark, sf).selectExpr("action_id div 3 AS action_id", "summary", "occurred_at", "action_id AS arrival")
    return f.first_write(rows, ["action_id"], "arrival").select("action_id", "summary", "occurred_at")


def settings_last_write(spark, sf):
    rows = b.fact_events(spark, sf).select("source", "entity_id", "value", "arrival")
    return f.last_write(rows, ["source", "entity_id"], "arrival")


QUERIES = {q.__name__: q for q in (fact_state_machine, fact_outcomes, current_facts, facts_as_of, facts_retire_entity, acl_correction_now_acl, chunk_versions, retract_token, retire_document, merged_record, actions_replayed, settings_last_write)}

_AS_OF = f"valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT})"
ORACLE_SQL = {
    "fact_state_machine": b.sql("fact_events", then=f",\n{_FOLD} SELECT * FROM facts"),
    "fact_outcomes": b.sql("fact_events", then=f",\n{_FOLD} SELECT source, n, inserted, superseded, stale, n - inserted - superseded - stale AS unchanged FROM (SELECT source, count(*) AS n FROM fact_events GROUP BY source) JOIN (SELECT source, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'superseded') AS superseded, count(*) FILTER (outcome = 'stale') AS stale FROM facts GROUP BY source) USING (source)"),
    "current_facts": b.sql("fact_events", then=f",\n{_FOLD}, {_ACL} SELECT source, entity_id, value, valid_from FROM facts JOIN acl USING (tenant, source, entity_id, field) WHERE {sql_scope(NARROW, chunk=False)}"),
    "facts_as_of": b.sql("fact_events", then=f",\n{_FOLD}, {_ACL} SELECT source, entity_id, value, valid_from FROM facts JOIN acl USING (tenant, source, entity_id, field) WHERE {sql_scope(SCOPE, chunk=False, current=False)} AND {_AS_OF} QUALIFY row_number() OVER (PARTITION BY tenant, source, entity_id, field ORDER BY valid_from DESC, arrival DESC) = 1"),
    "facts_retire_entity": b.sql("fact_events", then=f",\n{_FOLD} SELECT source, arrival, valid_from, CASE WHEN source = 'view' AND valid_to IS NULL THEN {b.BASE + 60 * b.DAY} ELSE valid_to END AS valid_to FROM facts WHERE entity_id = 'user:7'"),
    "acl_correction_now_acl": b.sql("fact_events", then=f",\n{_FOLD}, {_ACL}, r AS (SELECT f.*, CASE WHEN source = 'click' THEN [3] ELSE visibility END AS visibility, CASE WHEN source = 'click' THEN greatest(confidentiality, 1) ELSE confidentiality END AS confidentiality FROM facts f JOIN acl USING (tenant, source, entity_id, field)) SELECT source, entity_id, value FROM r WHERE confidentiality <= 2 AND list_contains(visibility, 3) AND {_AS_OF} QUALIFY row_number() OVER (PARTITION BY tenant, source, entity_id, field ORDER BY valid_from DESC, arrival DESC) = 1"),
    "chunk_versions": b.sql("chunks", then=f""", d AS (SELECT document_id, seq, content, document_id * 3600 AS valid_from FROM chunks UNION ALL SELECT document_id, seq, content || '!', document_id * 3600 + {b.DAY} FROM chunks WHERE document_id % 2 = 0 OR seq < 2),
per AS (SELECT document_id, valid_from, max(seq) AS last FROM d GROUP BY ALL)
SELECT document_id, seq, valid_from, (SELECT min(x) FROM (SELECT min(n.valid_from) AS x FROM d n WHERE n.document_id = d.document_id AND n.seq = d.seq AND n.valid_from > d.valid_from UNION ALL SELECT min(p.valid_from) FROM per p WHERE p.document_id = d.document_id AND p.valid_from > d.valid_from AND p.last < d.seq)) AS valid_to, length(content) AS n FROM d"""),
    "retract_token": b.sql("chunks", then=" SELECT source, count(*) FILTER (list_contains(visibility, 11)) AS rows_changed, count(DISTINCT CASE WHEN list_contains(visibility, 11) THEN document_id END) AS documents, CAST(sum(len(list_filter(visibility, lambda x: x <> 11))) AS BIGINT) AS tokens_left FROM chunks GROUP BY source"),
    "retire_document": b.sql("chunks", then=f" SELECT id, source, CASE WHEN source = 'src0' AND valid_to IS NULL THEN 0 ELSE len(visibility) END AS n_visible, CASE WHEN source = 'src0' AND valid_to IS NULL THEN {b.BASE + 90 * b.DAY} ELSE valid_to END AS valid_to FROM chunks WHERE document_id = 4"),
    "merged_record": b.sql("fact_events", then=f""",
{_FOLD}, {_ACL}, now AS (SELECT * FROM facts JOIN acl USING (tenant, source, entity_id, field) WHERE {sql_scope(SCOPE, chunk=False)}),
own AS (SELECT *, 'canon:' || (CAST(substr(entity_id, 6) AS BIGINT) % 40) AS canonical FROM now),
o AS (SELECT *, CASE WHEN canonical = 'canon:5' AND field = 'k' THEN ['view', 'error'] WHEN field = 'k' THEN ['purchase', 'signup', 'click'] WHEN canonical = 'canon:3' THEN ['error'] ELSE ['click', 'view'] END AS source_order FROM own),
r AS (SELECT *, coalesce(nullif(list_position(source_order, source), 0) - 1, len(source_order)) AS rank FROM o),
l AS (SELECT canonical, field, list(source ORDER BY rank, valid_from DESC, source, entity_id) AS ss, list(coalesce(value, '') ORDER BY rank, valid_from DESC, source, entity_id) AS vs, arg_min(value, [rank, -valid_from]) AS unused FROM r GROUP BY ALL)
SELECT canonical, field, vs[1] AS value, ss[1] AS source, CAST(len(ss) - 1 AS INT) AS n_alternatives, array_to_string(list_transform(list_zip(ss, vs)[2:], lambda x: x[1] || '=' || x[2]), ';') AS alternatives FROM l"""),
    "actions_replayed": b.sql("actions", then=" SELECT action_id // 3 AS action_id, arg_min(summary, action_id) AS summary, arg_min(occurred_at, action_id) AS occurred_at FROM actions GROUP BY 1"),
    "settings_last_write": b.sql("fact_events", then=" SELECT source, entity_id, arg_max(value, arrival) AS value, max(arrival) AS arrival FROM fact_events GROUP BY ALL"),
}
