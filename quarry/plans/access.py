"""Queries of the access graph, identities and revocations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import bindings as b
from quarry.operators import access as a
from quarry.operators import facts, graph
from quarry.operators import scope as sc
from quarry.plans import temporal
from quarry.session import table


def _edges(spark, sf):
    """Users in nations, nations in regions, regions in one another's ring."""
    c = table(spark, sf, "customer").selectExpr("'user:' || c_custkey AS member", "'nation:' || c_nationkey AS parent")
    n = table(spark, sf, "nation").selectExpr("'nation:' || n_nationkey AS member", "'region:' || n_regionkey AS parent")
    r = table(spark, sf, "region").selectExpr("'region:' || r_regionkey AS member", "'region:' || ((r_regionkey + 1) % 3) AS parent")
    return c.unionByName(n).unionByName(r)


def _grants(spark, sf):
    return table(spark, sf, "nation").selectExpr("'obj:' || (n_nationkey % 4) AS object", "'nation:' || n_nationkey AS principal").unionByName(table(spark, sf, "region").selectExpr("'obj:' || r_regionkey AS object", "'region:' || r_regionkey AS principal"))


_EDGES = """edges AS (SELECT 'user:' || c_custkey AS member, 'nation:' || c_nationkey AS parent FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'region:' || ((r_regionkey + 1) % 3) FROM region),
closure AS (SELECT member, parent AS ancestor FROM edges UNION SELECT c.member, e.parent FROM closure c JOIN edges e ON c.ancestor = e.member)"""


def group_closure(spark, sf):
    return graph.closure(_edges(spark, sf))


def users_via_groups(spark, sf):
    return graph.users_via_groups(_edges(spark, sf), _grants(spark, sf))


def group_removal_tombstones(spark, sf):
    return graph.tombstones(_edges(spark, sf), "nation:7", b.BASE)


def access_corpus(spark, sf):
    return a.corpus(b.chunks(spark, sf), "a")


LABEL = "CASE WHEN doc_id % 5 = 0 THEN 'declared' WHEN doc_id % 7 = 0 THEN 'derived' ELSE 'mirrored' END"


def grant_confidence(spark, sf):
    return a.grant_confidence(b.chunks(spark, sf).withColumn("label", F.expr(LABEL.replace("doc_id", "id"))), "a")


def access_documents_page(spark, sf):
    return a.documents_page(b.chunks(spark, sf), "a", 40, (b.BASE + 30 * b.DAY, 500))


def object_tokens(spark, sf):
    return a.object_tokens(b.chunks(spark, sf), "a")


def _tombstones(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").selectExpr("user_id AS token", f"{b.SECONDS.format('ts')} AS at")


_TOMB = f"tombstones AS (SELECT user_id AS token, {b._E.format('ts')} AS at_s FROM events WHERE event_type = 'error')"
ISSUED = b.BASE + 20 * b.DAY


def revocation_subtraction(spark, sf):
    tokens = table(spark, sf, "customer").selectExpr("c_custkey AS token")
    revoked = tokens.where("token % 50 = 0")
    return sc.subtract_tokens(tokens, _tombstones(spark, sf), revoked, ISSUED)


def windowed_revoked(spark, sf):
    return sc.windowed_revoked(_tombstones(spark, sf), ISSUED)


def token_allocation(spark, sf):
    known = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").selectExpr("'actor:' || (s_suppkey % 20) AS principal", "s_suppkey % 20 AS token").distinct()
    return sc.allocate_tokens(known, b.actions(spark, sf).selectExpr("actor AS principal", "occurred_at AS at"))


def crosswalk_resolve(spark, sf):
    links = table(spark, sf, "customer").selectExpr("c_mktsegment AS source", "c_name AS local_id", "'p:' || (c_custkey % 97) AS canonical", "c_custkey % 9 <> 0 AS active")
    canonical = table(spark, sf, "supplier").selectExpr("'p:' || s_suppkey AS canonical", "s_suppkey % 6 <> 0 AS active")
    return a.resolve_local(links, canonical)


def idp_subject_resolve(spark, sf):
    subjects = table(spark, sf, "customer").selectExpr("'s' || c_custkey AS subject")
    canonical = table(spark, sf, "supplier").selectExpr("'p:' || s_suppkey AS canonical", "'s' || (s_suppkey * 2) AS idp_subject", "s_suppkey % 6 <> 0 AS active")
    aliases = table(spark, sf, "supplier").selectExpr("'s' || (s_suppkey * 3) AS alias", "'p:' || s_suppkey AS canonical")
    return a.resolve_subject(subjects, canonical, aliases)


def fsck(spark, sf):
    principals = spark.range(0, 12).withColumnRenamed("id", "token")
    quarantine = table(spark, sf, "events").where("event_type = 'error'").selectExpr("event_id AS id", "CASE WHEN event_id % 3 = 0 THEN value END AS resolved_at")
    return a.fsck(b.chunks(spark, sf), facts.versions(b.fact_events(spark, sf)), principals, quarantine)


def snapshot_diff(spark, sf):
    c = table(spark, sf, "customer")
    before = c.where("c_custkey % 7 <> 0").selectExpr("c_name AS name", "c_mktsegment AS v")
    after = c.where("c_custkey % 5 <> 0").selectExpr("c_name AS name", "CASE WHEN c_custkey % 11 = 0 THEN 'MOVED' ELSE c_mktsegment END AS v")
    return graph.snapshot_diff(before, after, "name", "v")


def acl_diff(spark, sf):
    rows = b.chunks(spark, sf).selectExpr("id", "visibility AS prior", "CASE WHEN id % 4 = 0 THEN array(id % 7, 12L) ELSE visibility END AS current")
    return graph.acl_diff(rows).select("id", F.array_join("removed", ",").alias("removed"), F.array_join("added", ",").alias("added"), "tightened").where("size(split(removed, ',')) > 0 AND (removed <> '' OR added <> '')")


def fidelity_confusion(spark, sf):
    o = table(spark, sf, "orders")
    pairs = o.selectExpr("o_custkey AS user", "o_orderkey % 50 AS record")
    granted = o.where("o_orderkey % 9 <> 0").selectExpr("o_custkey AS user", "o_orderkey % 50 AS record")
    truth = o.where("o_orderkey % 10 <> 0").selectExpr("o_custkey AS user", "(CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1 ELSE o_orderkey END) % 50 AS record")
    users = table(spark, sf, "customer").selectExpr("c_custkey AS user", "c_custkey % 4 <> 0 AS federated", "c_custkey % 7 = 0 AS view_all")
    return graph.fidelity(pairs, granted, truth, users).groupBy("verdict", "cause").agg(F.count("*").alias("n"))


QUERIES = {q.__name__: q for q in (group_closure, users_via_groups, group_removal_tombstones, access_corpus, grant_confidence, access_documents_page, object_tokens, revocation_subtraction, windowed_revoked, token_allocation, crosswalk_resolve, idp_subject_resolve, fsck, snapshot_diff, acl_diff, fidelity_confusion)}

ORACLE_SQL = {
    "group_closure": f"WITH RECURSIVE {_EDGES} SELECT * FROM closure",
    "users_via_groups": f"""WITH RECURSIVE {_EDGES}, grants AS (SELECT 'obj:' || (n_nationkey % 4) AS object, 'nation:' || n_nationkey AS principal FROM nation UNION ALL SELECT 'obj:' || r_regionkey, 'region:' || r_regionkey FROM region),
v AS (SELECT object, member AS user, list_sort(list(DISTINCT ancestor)) AS g FROM closure JOIN grants ON ancestor = principal WHERE member LIKE 'user:%' GROUP BY ALL)
SELECT object, "user", array_to_string(g[1:5], ',') AS groups, CAST(len(g) AS INT) AS n_groups FROM v""",
    "group_removal_tombstones": f"WITH RECURSIVE {_EDGES}, lost AS (SELECT ancestor AS lost FROM closure WHERE member = 'nation:7' UNION ALL SELECT 'nation:7') SELECT member AS principal, lost, {b.BASE} AS at FROM closure CROSS JOIN lost WHERE ancestor = 'nation:7'",
    "access_corpus": b.sql("chunks", then=""" SELECT CASE WHEN grouping(source, confidentiality) = 3 THEN 'all' WHEN grouping(source, confidentiality) = 1 THEN 'source' ELSE 'confidentiality' END AS lane,
coalesce(source, CAST(confidentiality AS VARCHAR), '') AS key, count(*) AS n_rows, count(DISTINCT (source, document_id)) AS n_documents FROM chunks WHERE tenant = 'a' GROUP BY GROUPING SETS ((), (source), (confidentiality))"""),
    "grant_confidence": b.sql("chunks", then=f", l AS (SELECT source, {LABEL.replace('doc_id', 'id')} AS label, count(*) AS n FROM chunks WHERE tenant = 'a' GROUP BY ALL) SELECT source, label, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM l"),
    "access_documents_page": b.sql("chunks", then=f", p AS (SELECT * FROM chunks WHERE tenant = 'a' AND valid_to IS NULL AND (valid_from, id) < ({b.BASE + 30 * b.DAY}, 500) ORDER BY valid_from DESC, id DESC LIMIT 40) SELECT source, document_id, min(confidentiality) AS confidentiality, max(valid_from) AS valid_from, count(*) AS n_chunks, arg_max(id, (valid_from, id)) AS first_seen FROM p GROUP BY ALL"),
    "object_tokens": b.sql("chunks", then=", t AS (SELECT DISTINCT source, document_id, unnest(visibility) AS token FROM chunks WHERE tenant = 'a'), g AS (SELECT source, document_id, string_agg(CAST(token AS VARCHAR), ',' ORDER BY token) AS tokens FROM t GROUP BY ALL) SELECT source, document_id, confidentiality, tokens FROM (SELECT source, document_id, min(confidentiality) AS confidentiality FROM chunks WHERE tenant = 'a' GROUP BY ALL) LEFT JOIN g USING (source, document_id)"),
    "revocation_subtraction": f"WITH {_TOMB}, f AS (SELECT token, min(at_s) AS first_at FROM tombstones GROUP BY token) SELECT c_custkey AS token, first_at, c_custkey % 50 <> 0 AND NOT coalesce(first_at >= {ISSUED}, false) AS kept FROM customer LEFT JOIN f ON token = c_custkey",
    "windowed_revoked": f"WITH {_TOMB} SELECT DISTINCT token FROM tombstones WHERE at_s > {ISSUED - sc.REVOCATION_WINDOW}",
    "token_allocation": b.sql("actions", then=", known AS (SELECT DISTINCT 'actor:' || (s_suppkey % 20) AS principal, s_suppkey % 20 AS token FROM supplier WHERE s_suppkey % 2 = 0), fresh AS (SELECT actor AS principal, min(occurred_at) AS at_s FROM actions WHERE actor NOT IN (SELECT principal FROM known) GROUP BY actor) SELECT * FROM known UNION ALL SELECT principal, row_number() OVER (ORDER BY at_s, principal) + (SELECT coalesce(max(token), 0) FROM known) FROM fresh"),
    "crosswalk_resolve": "SELECT c_mktsegment AS source, c_name AS local_id, 'p:' || (c_custkey % 97) AS canonical FROM customer JOIN supplier ON s_suppkey = c_custkey % 97 WHERE c_custkey % 9 <> 0 AND s_suppkey % 6 <> 0",
    "idp_subject_resolve": "WITH ok AS (SELECT * FROM supplier WHERE s_suppkey % 6 <> 0) SELECT 's' || c_custkey AS subject, coalesce('p:' || d.s_suppkey, 'p:' || i.s_suppkey) AS canonical FROM customer LEFT JOIN ok d ON d.s_suppkey * 2 = c_custkey LEFT JOIN ok i ON i.s_suppkey * 3 = c_custkey",
    "fsck": b.sql("chunks", "fact_events", then=f""",
{temporal._FOLD}, r AS (SELECT 'class_out_of_range' AS "check", 'error' AS severity, count(*) AS n FROM chunks WHERE confidentiality NOT BETWEEN 0 AND 3
UNION ALL SELECT 'chunk_interval_inverted', 'error', count(*) FROM chunks WHERE valid_to < valid_from UNION ALL SELECT 'fact_interval_inverted', 'error', count(*) FROM facts WHERE valid_to < valid_from
UNION ALL SELECT 'visibility_empty', 'warning', count(*) FROM chunks WHERE len(visibility) = 0 AND valid_to IS NULL UNION ALL SELECT 'unresolved_tokens', 'warning', count(DISTINCT t) FROM (SELECT unnest(visibility) AS t FROM chunks) WHERE t NOT BETWEEN 0 AND 11
UNION ALL SELECT 'quarantine_open', 'info', count(*) FROM events WHERE event_type = 'error' AND (event_id % 3 <> 0 OR value IS NULL)) SELECT * FROM r WHERE n > 0"""),
    "snapshot_diff": "WITH b AS (SELECT c_name AS name, c_mktsegment AS v FROM customer WHERE c_custkey % 7 <> 0), a AS (SELECT c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN 'MOVED' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0) SELECT coalesce(b.name, a.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a ON b.name = a.name WHERE b.name IS NULL OR a.name IS NULL OR a.v IS DISTINCT FROM b.v",
    "acl_diff": b.sql("chunks", then=", d AS (SELECT id, visibility AS p, CASE WHEN id % 4 = 0 THEN [id % 7, 12] ELSE visibility END AS c FROM chunks), e AS (SELECT id, list_sort(list_filter(p, lambda x: NOT list_contains(c, x))) AS r, list_sort(list_filter(c, lambda x: NOT list_contains(p, x))) AS a FROM d) SELECT id, array_to_string(r, ',') AS removed, array_to_string(a, ',') AS added, len(r) > 0 AS tightened FROM e WHERE len(r) + len(a) > 0"),
    "fidelity_confusion": """WITH p AS (SELECT DISTINCT o_custkey AS u, o_orderkey % 50 AS r FROM orders), g AS (SELECT DISTINCT o_custkey AS u, o_orderkey % 50 AS r FROM orders WHERE o_orderkey % 9 <> 0),
t AS (SELECT DISTINCT o_custkey AS u, (CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1 ELSE o_orderkey END) % 50 AS r FROM orders WHERE o_orderkey % 10 <> 0),
v AS (SELECT u, (u, r) IN (SELECT (u, r) FROM t) AS readable, (u, r) IN (SELECT (u, r) FROM g) AS let_in FROM p)
SELECT CASE WHEN readable AND let_in THEN 'match_grant' WHEN readable THEN 'over_hide' WHEN let_in THEN 'under_hide' ELSE 'match_deny' END AS verdict,
CASE WHEN NOT readable OR let_in THEN 'none' WHEN u % 4 = 0 THEN 'unmapped_identity' WHEN u % 7 = 0 THEN 'view_all' ELSE 'non_floor' END AS cause, count(*) AS n FROM v GROUP BY 1, 2""",
}
