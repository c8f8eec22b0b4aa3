"""Queries of consolidation: canonical forms, the judge, the merge cascade, evidence, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import bindings as b
from quarry.operators import consolidate as c
from quarry.operators import knowledge as k
from quarry.plans.operations import EV
from quarry.session import table

# four wordings around five things that may be required
THING = "CASE event_id % 5 WHEN 0 THEN 'data processing agreement' WHEN 1 THEN 'SOC 2 report' WHEN 2 THEN 'penetration test' WHEN 3 THEN 'security questionnaire' ELSE 'BAA' END"
STATEMENT = (
    "CASE event_id % 4 WHEN 0 THEN 'Enterprise buyers always require a ' || {t} || ' before the security review.' WHEN 1 THEN 'Security review is blocked until a ' || {t} || ' is signed (draft).' "
    "WHEN 2 THEN 'Customers tend to need a ' || {t} || '.' ELSE 'Some teams often like blue K' || (event_id % 7) || ' widgets!' END"
).format(t=THING)
_TOKEN = "CASE event_id % 5 WHEN 0 THEN 'signed_dpa' WHEN 1 THEN 'soc2_report' WHEN 2 THEN 'pentest' WHEN 3 THEN 'security_questionnaire' ELSE 'signed_baa' END"
#: The form that the wordings above have by rule.
_FORM = f"CASE event_id % 4 WHEN 0 THEN 'segment_buyer requires ' || {_TOKEN} || ' before security_review' WHEN 1 THEN 'requires ' || {_TOKEN} || ' before security_review' WHEN 2 THEN 'segment_buyer requires ' || {_TOKEN} ELSE 'segment_buyer blue k' || (event_id % 7) || ' like widgets' END"


def _statements(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id AS id", f"{STATEMENT} AS statement", "user_id")
    return e.withColumn("canonical", c.canonical_statement(F.col("statement")))


def canonical_statements(spark, sf):
    return _statements(spark, sf).select("id", "canonical", F.array_join(c.artifacts(F.col("canonical")), ",").alias("artifacts"))


def _items(spark, sf):
    """Known items: every 37th statement, in all statuses; some have no canonical form."""
    own = _statements(spark, sf).where("id % 37 = 0").withColumn("status", F.expr("CASE id % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'published' WHEN 2 THEN 'rejected' WHEN 3 THEN 'eligible' ELSE 'invalidated' END"))
    return own.selectExpr("id AS knowledge_id", "statement", "CASE WHEN id % 3 <> 0 THEN canonical END AS canonical", "status", "id * 60 AS first_seen")


_ITEMS = f"st AS (SELECT event_id AS id, {STATEMENT} AS statement, {_FORM} AS canonical FROM events), items AS (SELECT id AS knowledge_id, statement, CASE WHEN id % 3 <> 0 THEN canonical END AS canonical, CASE id % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'published' WHEN 2 THEN 'rejected' WHEN 3 THEN 'eligible' ELSE 'invalidated' END AS status, id * 60 AS first_seen FROM st WHERE id % 37 = 0)"


def judge_merges(spark, sf):
    return c.judged(_statements(spark, sf), _items(spark, sf))


def merge_cascade(spark, sf):
    proposals = _statements(spark, sf).selectExpr("id", "statement", "CASE WHEN id % 4 <> 3 OR id % 2 = 0 THEN canonical END AS canonical", "CASE WHEN id % 6 = 0 THEN id div 37 * 37 END AS merge_into")
    lexicon = spark.createDataFrame([("k3 widgets",), ("penetration",), ("xy",)], "term string")
    known = _items(spark, sf).where("NOT (canonical LIKE '%soc2%' AND status <> 'rejected') OR canonical IS NULL")
    return c.cascade(proposals, known, lexicon)


def evidence_merged(spark, sf):
    ev = spark.sql(f"SELECT {EV} FROM {{e}}", e=table(spark, sf, "events"))
    items = k.support(ev.where("episode_id % 3 = 0")).withColumn("status", F.expr("CASE WHEN knowledge_id % 2 = 0 THEN 'published' ELSE 'candidate' END"))
    return c.merge_evidence(items, ev.where("episode_id % 3 = 0"), ev.where("episode_id % 3 <> 2 AND knowledge_id % 5 <> 4"))[0]


def knowledge_decisions(spark, sf):
    d = table(spark, sf, "events").where("event_id % 2 = 0").selectExpr("event_id AS knowledge_id", "CASE event_id % 6 WHEN 0 THEN 'eligible' WHEN 2 THEN 'reject' ELSE 'other' END AS decision", "'r' || event_id AS reason")
    return c.decided(_items(spark, sf).select("knowledge_id", "status"), d, b.BASE)


def knowledge_chunks(spark, sf):
    ev = spark.sql(f"SELECT {EV} FROM {{e}}", e=table(spark, sf, "events"))
    items = k.support(ev).selectExpr("knowledge_id", "entities", "CASE WHEN knowledge_id % 2 = 0 THEN 'published' ELSE 'eligible' END AS status", "'s' || knowledge_id AS statement", "array(knowledge_id % 7) AS visibility")
    return c.knowledge_chunk(items, b.BASE).withColumn("visibility", F.array_join("visibility", ","))


def l2_facts_written(spark, sf):
    facts = table(spark, sf, "events").selectExpr("event_id % 400 AS episode_id", "' Acme \t Corp ' || (user_id % 5) AS subject", "'Requires  Before' AS predicate", "CAST(event_id AS STRING) AS object")
    chunks = b.chunks(spark, sf).selectExpr("document_id AS episode_id", "visibility", "confidentiality")
    return k.l2_facts_write(facts, chunks).withColumn("visibility", F.array_join("visibility", ","))


QUERIES = {q.__name__: q for q in (canonical_statements, judge_merges, merge_cascade, evidence_merged, knowledge_decisions, knowledge_chunks, l2_facts_written)}

_ART = "CASE WHEN id % 4 <> 3 THEN CASE id % 5 WHEN 0 THEN 'signed_dpa' WHEN 1 THEN 'soc2_report' WHEN 2 THEN 'pentest' WHEN 3 THEN 'security_questionnaire' ELSE 'signed_baa' END ELSE '' END"
ORACLE_SQL = {
    "canonical_statements": f"WITH {_ITEMS} SELECT id, canonical, {_ART} AS artifacts FROM st",
    "judge_merges": f"""WITH {_ITEMS}, live AS (SELECT *, knowledge_id AS id FROM items WHERE status IN ('candidate', 'published')), form AS (SELECT canonical, min(knowledge_id) AS m FROM live WHERE canonical <> '' GROUP BY 1),
what AS (SELECT {_ART} AS a, min(knowledge_id) AS m FROM live WHERE canonical IS NOT NULL AND id % 4 <> 3 GROUP BY 1)
SELECT id, least(f.m, w.m) AS merge_into FROM (SELECT *, {_ART} AS a FROM st) s LEFT JOIN form f USING (canonical) LEFT JOIN what w ON w.a = s.a""",
    "merge_cascade": f"""WITH {_ITEMS}, i AS (SELECT * FROM items WHERE NOT (canonical LIKE '%soc2%' AND status <> 'rejected') OR canonical IS NULL),
p AS (SELECT id, statement, CASE WHEN id % 4 <> 3 OR id % 2 = 0 THEN canonical END AS form, CASE WHEN id % 6 = 0 THEN id // 37 * 37 END AS merge_into FROM st),
e AS (SELECT canonical AS form, arg_min(knowledge_id, first_seen) AS exact FROM i WHERE status IN ('candidate', 'published') AND canonical IS NOT NULL GROUP BY 1),
rf AS (SELECT canonical AS form, min(knowledge_id) AS k FROM i WHERE status = 'rejected' GROUP BY 1), rt AS (SELECT statement, min(knowledge_id) AS k FROM i WHERE status = 'rejected' GROUP BY 1),
tf AS (SELECT canonical AS form, min(knowledge_id) AS k FROM i WHERE status IN ('candidate', 'eligible') GROUP BY 1), tt AS (SELECT statement, min(knowledge_id) AS k FROM i WHERE status IN ('candidate', 'eligible') GROUP BY 1),
x AS (SELECT p.*, exact, CASE WHEN merge_into IN (SELECT knowledge_id FROM i WHERE status IN ('candidate', 'published')) THEN merge_into END AS judge, CASE WHEN p.form IS NULL THEN rt.k ELSE rf.k END AS rejected,
  contains(lower(p.statement), 'k3 widgets') OR contains(lower(p.statement), 'penetration') AS named, least(tf.k, tt.k) AS twin
  FROM p LEFT JOIN e ON e.form = p.form LEFT JOIN rf ON rf.form = p.form LEFT JOIN rt ON rt.statement = p.statement LEFT JOIN tf ON tf.form = p.form LEFT JOIN tt ON tt.statement = p.statement)
SELECT id, CASE WHEN exact IS NOT NULL THEN 'canonical_exact' WHEN judge IS NOT NULL THEN 'judge' WHEN rejected IS NOT NULL THEN 'rejected_memory' WHEN named THEN 'quarantined' WHEN twin IS NOT NULL THEN 'accrued' ELSE 'inserted' END AS outcome,
CASE WHEN exact IS NULL AND judge IS NULL AND rejected IS NULL AND named THEN NULL ELSE coalesce(exact, judge, rejected, twin) END AS knowledge_id FROM x""",
    "evidence_merged": f"""WITH ev AS (SELECT {EV} FROM events), old AS (SELECT knowledge_id, count(DISTINCT entity) AS entities, count(*) AS evidence, count(DISTINCT writer) AS writers, bool_or(trust_tier = 1) AS has_tier1 FROM ev WHERE episode_id % 3 = 0 GROUP BY 1),
upd AS (SELECT knowledge_id, count(DISTINCT entity) AS entities, count(*) AS evidence, count(DISTINCT writer) AS writers, bool_or(trust_tier = 1) AS has_tier1 FROM ev WHERE episode_id % 3 <> 2 AND knowledge_id % 5 <> 4 GROUP BY 1),
m AS (SELECT o.knowledge_id, coalesce(u.entities, o.entities) AS entities, coalesce(u.evidence, o.evidence) AS evidence, coalesce(u.writers, o.writers) AS writers, o.has_tier1 OR coalesce(u.has_tier1, false) AS has_tier1, CASE WHEN o.knowledge_id % 2 = 0 THEN 'published' ELSE 'candidate' END AS status FROM old o LEFT JOIN upd u USING (knowledge_id))
SELECT *, CASE WHEN status = 'published' THEN CASE WHEN entities >= 10 THEN 'extensive' WHEN entities >= 5 THEN 'established' WHEN entities >= 3 THEN 'emerging' END END AS tier FROM m""",
    "knowledge_decisions": f"WITH {_ITEMS}, d AS (SELECT knowledge_id, status, CASE WHEN knowledge_id % 2 = 0 THEN CASE knowledge_id % 6 WHEN 0 THEN 'eligible' WHEN 2 THEN 'reject' ELSE 'other' END END AS decision FROM items), r AS (SELECT *, coalesce(decision = 'reject' AND status IN ('candidate', 'eligible', 'quarantined'), false) AS drops FROM d) SELECT knowledge_id, CASE WHEN decision = 'eligible' AND status = 'candidate' THEN 'eligible' WHEN drops THEN 'rejected' ELSE status END AS status, CASE WHEN drops THEN 'r' || knowledge_id END AS reject_reason, CASE WHEN drops THEN {b.BASE} END AS rejected_at FROM r",
    "knowledge_chunks": f"WITH ev AS (SELECT {EV} FROM events), s AS (SELECT knowledge_id, count(DISTINCT entity) AS n FROM ev GROUP BY 1) SELECT 'knowledge:' || knowledge_id AS document_id, 0 AS seq, 's' || knowledge_id AS content, CAST(knowledge_id % 7 AS VARCHAR) AS visibility, 'knowledge' AS kind, CASE WHEN n >= 10 THEN 'extensive' WHEN n >= 5 THEN 'established' ELSE 'emerging' END AS support_tier, {b.BASE} AS valid_from FROM s WHERE knowledge_id % 2 = 0 AND n >= 3",
    "l2_facts_written": b.sql("chunks", then=""", a AS (SELECT document_id AS episode_id, list_sort(list_reduce(list(visibility), lambda x, y: list_intersect(x, y))) AS v, max(confidentiality) AS c FROM chunks GROUP BY 1)
SELECT 'l2' AS source, 'acme corp ' || (user_id % 5) AS entity_id, 'requires before' AS field, CAST(event_id AS VARCHAR) AS value, event_id % 400 AS episode_id, coalesce(array_to_string(v, ','), '') AS visibility, coalesce(c, 3) AS confidentiality FROM events LEFT JOIN a ON a.episode_id = event_id % 400"""),
}
