"""Queries of what is kept up to date: the fold, joins through time, hierarchies, sketches, erasure on files, watched folders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import bindings as b
from quarry.operators import asof, file_erasure, hierarchy, reads, sketches
from quarry.operators import graph as g
from quarry.operators import knowledge as k
from quarry.operators.refold import Resolution
from quarry.plans import operations, resolution, temporal
from quarry.plans.recall import SCOPE
from quarry.plans.streams import _Streams
from quarry.session import kept, shared_dir, table
from quarry.sources import documents
from quarry.streaming import refresh
from quarry.streaming import subscribe as sub


def _refolded(spark, sf) -> Resolution:
    """Evidence in three batches, by a hash of its id."""
    evidence = resolution._evidence(spark, sf)
    store = Resolution(spark, f"{shared_dir(spark)}/fold-{uuid.uuid4().hex}", resolution.CONFIG)
    for turn in range(3):
        store.add(evidence.where(F.pmod(F.xxhash64("id"), F.lit(3)) == turn))
    return store


def refold_aliases(spark, sf):
    """The fold of evidence that came in three batches; each folds again only what it touches."""
    return _refolded(spark, sf).aliases()


def refold_reviews(spark, sf):
    return _refolded(spark, sf).reviews()


QUIET = 6 * 3600


def refold_due(spark, sf):
    """Users whose bursts of events have been quiet for six hours, as a stream."""
    touches = table(_Streams(spark), sf, "events").selectExpr("'user:' || user_id AS subject", "CAST(date_trunc('second', ts) AS TIMESTAMP) AS at")
    folder = sub.run_once(refresh.due(touches, QUIET), "due")
    return spark.read.schema(refresh.DUE).parquet(folder)


def asof_events(spark, sf):
    """Each event with the fact that held of its user's source when it happened, and whether it still held."""
    probes = table(spark, sf, "events").selectExpr("event_id", "event_type AS source", "'user:' || user_id AS entity_id", f"{b.SECONDS.format('ts')} - 43200 AS at")
    versions = temporal._facts(spark, sf).select("source", "entity_id", "valid_from", "valid_to", "value", "arrival")
    rows = asof.asof_join(probes, versions, ["source", "entity_id"], "at", "valid_from", ["valid_from", "valid_to", "value"], "arrival")
    return rows.select("event_id", "valid_from", "value", F.coalesce(F.col("at") < F.col("valid_to"), F.col("valid_from").isNotNull()).alias("holds"))


def _roles(spark, sf):
    """A tree of roles by customer number, with a cycle among three of them."""
    c = table(spark, sf, "customer")
    return c.selectExpr("'role:' || c_custkey AS role", "CASE WHEN c_custkey IN (3, 4) THEN 'role:' || (c_custkey + 1) WHEN c_custkey = 5 THEN 'role:3' WHEN c_custkey > 5 THEN 'role:' || (c_custkey div 3) END AS parent")


def role_ancestors(spark, sf):
    return hierarchy.role_ancestors(_roles(spark, sf))


def _role_tables(spark, sf):
    o = table(spark, sf, "orders")
    records = o.selectExpr("'rec:' || o_orderkey AS record", "'u:' || o_custkey AS owner")
    users = table(spark, sf, "customer").selectExpr("'u:' || c_custkey AS user", "'role:' || c_custkey AS role")
    parents = o.where("o_orderkey % 7 = 0").selectExpr("'rec:' || o_orderkey AS record", "'rec:' || (o_orderkey div 7 * 2) AS parent")
    return records, users, parents


def role_grants(spark, sf):
    """Who sees a record through the roles above its owner's; every seventh has its parent's grants instead."""
    records, users, parents = _role_tables(spark, sf)
    return hierarchy.role_grants(records, users, _roles(spark, sf), parents)


def role_fidelity(spark, sf):
    """Grants through roles held against what the source lets its managers read: verdicts by cause."""
    records, users, parents = _role_tables(spark, sf)
    read = F.expr("(CAST(substr(record, 5) AS LONG) * 7 + CAST(substr(user, 3) AS LONG)) % 10 <> 0")
    granted = hierarchy.reaching(records, users, _roles(spark, sf), parents).select("user", "record", F.lit(True).alias("g"), read.alias("t"))
    shared = records.where("CAST(substr(record, 5) AS LONG) % 5 = 0").select(F.col("owner").alias("user"), "record", F.lit(False).alias("g"), F.lit(True).alias("t"))
    facts = users.selectExpr("user", "CAST(substr(user, 3) AS INT) % 4 <> 0 AS federated", "CAST(substr(user, 3) AS INT) % 6 = 1 AS view_all")
    out = g.judged(granted.unionByName(shared), facts)
    return out.groupBy("verdict", "cause").agg(F.count("*").alias("n"))


def _samples(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_returnflag AS `group`", f"{b.SECONDS.format('l_shipdate')} AS at", "CAST(l_extendedprice AS DOUBLE) AS value")


def percentiles_merged(spark, sf):
    """Percentiles over three years from hourly sketches, with the exact ones and how far off their ranks are."""
    samples = _samples(spark, sf)
    start, end = 220_000, 246_000
    hours = kept(sketches.hourly(samples))
    found = sketches.over(hours, start, end)
    rows = samples.where(F.floor(F.col("at") / 3600).between(start, end - 1)).join(F.broadcast(found.select("group", "p50", "p95", "p99")), "group")
    off = [F.abs(F.avg((F.col("value") <= F.col(f"p{p}")).cast("double")) - p / 100).alias(f"off{p}") for p in sketches.PERCENTS]
    return found.join(rows.groupBy("group").agg(*off), "group").select("group", "n", "least", "most", *((F.col(f"off{p}") <= sketches.RANK_ERROR).alias(f"p{p}_within") for p in sketches.PERCENTS))


def latency_sketched(spark, sf):
    """The percentiles themselves, by operation, as merged from the sketches of every hour."""
    samples = table(spark, sf, "events").selectExpr("event_type AS `group`", f"{b.SECONDS.format('ts')} AS at", "value")
    return sketches.over(kept(sketches.hourly(samples)), 0, 1 << 40)


def _on_files(spark, sf):
    """The tables of an erasure as files, dealt by their keys, so that few of them hold any one subject's rows."""
    from quarry.sources.files import Files

    base = f"{shared_dir(spark)}/erase-{uuid.uuid4().hex}"
    tables = operations._tables(spark, sf)
    tables["evidence"] = tables["evidence"].withColumn("evidence_id", F.col("episode_id"))
    tables["items"] = tables["items"].withColumn("invalidated_reason", F.lit(None).cast("string"))
    out = {}
    for name, df in tables.items():
        out[name] = Files(spark, f"{base}/{name}", df.schema)
        out[name].add(df.repartitionByRange(8, file_erasure.KEYS[name][0]))
    return out


def erasure_on_files(spark, sf):
    """What is left on the files after an erasure that rewrote only those that held its rows."""
    files = _on_files(spark, sf)
    file_erasure.erase_on_files(files, b.BASE, operations.SUBJECT, operations.ENTITY, (3, 5, 99999999))
    left = {name: f.read() for name, f in files.items()}
    left["knowledge_evidence"] = left.pop("evidence")
    rows = k.erasure_preview(left)
    return rows.unionByName(k.erasure_preview({"facts_linked": left["facts"].where("superseded_by IS NOT NULL"), "chunks_current": left["chunks"].where("valid_to IS NULL"), "items_published": left["items"].where("status = 'published'")}))


def folder_versions(spark, sf):
    """A watched folder: texts by source and language, some delivered again unchanged, some with more lines; versions of each."""
    base = f"{shared_dir(spark)}/folder-{uuid.uuid4().hex}"
    docs = table(spark, sf, "labels").selectExpr("'s' || doc_id % 9 AS source", "doc_id", "concat(doc_id, ',', quality, ',', toxic) AS value")
    # a document is one row, its lines in order: what writes folders sorts by these, and drops a sort of lines made before
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "value"))), lambda x: x["value"]), "\n")
    deliver = lambda rows, scan: rows.groupBy("source").agg(content.alias("value")).select("value", F.concat(F.lit(f"{scan}-"), "source").alias("document")).write.mode("append").partitionBy("document").text(f"{base}/in")
    for scan, rows in enumerate((docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 <> 0 AND source < 's5'"), docs.where("source > 's2'"))):
        deliver(rows, scan)
        found = documents.delivered(documents.read_texts(spark, f"{base}/in", stream=True), r"document=\d+-([^/]+)/")
        sub.run_once(found, "folder", f"{base}/state", f"{base}/out")
    rows = documents.versions(spark.read.parquet(f"{base}/out"))
    return rows.select("document", "version", (F.size(F.split("content", "\n")) - 1).alias("n_lines"), "content_hash")


def brief_refresh(spark, sf):
    """Briefs of all entities, those of stale ones made anew, as a caller reads them: no summary whose sources one may not see."""
    chunks, actions = b.chunks(spark, sf), b.actions(spark, sf)
    old = chunks.where("tenant = 'a'").select(F.explode("tags").alias("entity")).distinct().selectExpr("entity", "concat('old ', entity) AS summary", "array(1L) AS source_visibility", "0L AS refreshed_at")
    stale = actions.where("action_id % 3 = 0").select(F.explode("entities").alias("entity")).unionByName(old.where("entity <> 'grp:0'").select("entity"))
    briefs = reads.refreshed_briefs(old, stale, chunks, actions, "a", b.BASE, 3)
    return reads.brief(briefs, SCOPE, "refreshed_at", F.array_join("source_visibility", ",").alias("visible_to"))


QUERIES = {q.__name__: q for q in (brief_refresh, erasure_on_files, folder_versions, refold_aliases, refold_reviews, refold_due, asof_events, role_ancestors, role_grants, role_fidelity, percentiles_merged, latency_sketched)}

_UP = """r AS (SELECT c_custkey AS role, CASE WHEN c_custkey IN (3, 4) THEN c_custkey + 1 WHEN c_custkey = 5 THEN 3 WHEN c_custkey > 5 THEN c_custkey // 3 END AS parent FROM customer),
up AS (SELECT role, parent AS ancestor, 1 AS level, [role, parent] AS passed FROM r WHERE parent IS NOT NULL
  UNION ALL SELECT u.role, r.parent, level + 1, list_append(passed, r.parent) FROM up u JOIN r ON r.role = u.ancestor WHERE r.parent IS NOT NULL AND NOT list_contains(passed, r.parent))"""
_GRANTS = """own AS (SELECT DISTINCT o_orderkey AS record, ancestor AS u FROM orders JOIN up ON role = o_custkey),
granted AS (SELECT * FROM own WHERE record % 7 <> 0 UNION SELECT o_orderkey, own.u FROM orders JOIN own ON own.record = o_orderkey // 7 * 2 WHERE o_orderkey % 7 = 0)"""

_MIN_VIS = "list_sort(list_reduce(list(visibility), lambda x, y: list_intersect(x, y)))"
ORACLE_SQL = {
    "brief_refresh": b.sql(
        "chunks",
        "actions",
        then=f""", o AS (SELECT DISTINCT unnest(tags) AS entity FROM chunks WHERE tenant = 'a'), st AS (SELECT unnest(entities) AS entity FROM actions WHERE action_id % 3 = 0 UNION SELECT entity FROM o WHERE entity <> 'grp:0'),
s AS (SELECT unnest(tags) AS entity, 'chunk' AS kind, id, valid_from AS t, visibility FROM chunks WHERE tenant = 'a' AND valid_to IS NULL UNION ALL SELECT unnest(entities), 'action', action_id, occurred_at, visibility FROM actions WHERE tenant = 'a'),
r AS (SELECT * FROM s WHERE entity IN (FROM st) QUALIFY row_number() OVER (PARTITION BY entity, kind ORDER BY t DESC, id DESC) <= 3),
n AS (SELECT entity, string_agg(kind || ':' || id, ' ' ORDER BY t DESC, kind DESC, id DESC) AS summary, {_MIN_VIS} AS v, {b.BASE} AS refreshed_at FROM r GROUP BY entity UNION ALL SELECT entity, 'old ' || entity, [1], 0 FROM o WHERE entity NOT IN (FROM st))
SELECT entity, CASE WHEN list_has_any(v, {list(SCOPE.principals)}) THEN summary END AS summary, refreshed_at, array_to_string(v, ',') AS visible_to FROM n""",
    ),
    "erasure_on_files": operations.ORACLE_SQL["erasure_survivors"],
    # text files end every line, so a file's bytes are its lines, each with a line feed
    "folder_versions": """WITH d AS (SELECT 's' || doc_id % 9 AS document, doc_id, doc_id || ',' || quality || ',' || toxic AS v FROM labels),
f AS (SELECT document, 1 AS version, string_agg(v || chr(10), '' ORDER BY doc_id) AS content, count(*) AS n FROM d WHERE doc_id % 10 <> 0 GROUP BY 1 UNION ALL SELECT document, 2, string_agg(v || chr(10), '' ORDER BY doc_id), count(*) FROM d WHERE document > 's2' GROUP BY 1 HAVING bool_or(doc_id % 10 = 0))
SELECT document, version, CAST(n AS INT) AS n_lines, sha256(content) AS content_hash FROM f""",
    "refold_aliases": resolution.ORACLE_SQL["fold_components"],
    "refold_reviews": resolution.ORACLE_SQL["fold_reviews"],
    "refold_due": f"""WITH e AS (SELECT 'user:' || user_id AS subject, epoch_us(ts) // 1000000 AS at_s FROM events), m AS (SELECT max(at_s) - 3600 AS mark FROM e),
l AS (SELECT *, coalesce(at_s - lag(at_s) OVER w > {QUIET}, true) AS first FROM e WINDOW w AS (PARTITION BY subject ORDER BY at_s)), n AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY subject ORDER BY at_s ROWS UNBOUNDED PRECEDING) AS burst FROM l)
SELECT subject, max(at_s) + {QUIET} AS due, count(*) AS touches FROM n GROUP BY subject, burst HAVING max(at_s) + {QUIET} <= (SELECT mark FROM m)""",
    "asof_events": b.sql(
        "fact_events",
        then=f""",
{temporal._FOLD}, v AS (SELECT source, entity_id, valid_from, arg_max(value, arrival) AS value, arg_max(coalesce(valid_to, 1e18), arrival) AS valid_to FROM facts GROUP BY ALL),
p AS (SELECT event_id, event_type AS source, 'user:' || user_id AS entity_id, epoch_us(ts) // 1000000 - 43200 AS at_s FROM events)
SELECT event_id, v.valid_from, v.value, coalesce(at_s < v.valid_to, false) AS holds FROM p ASOF LEFT JOIN v ON p.source = v.source AND p.entity_id = v.entity_id AND p.at_s >= v.valid_from""",
    ),
    "role_ancestors": f"WITH RECURSIVE {_UP} SELECT 'role:' || role AS role, 'role:' || ancestor AS ancestor, level FROM up",
    "role_grants": f"WITH RECURSIVE {_UP}, {_GRANTS} SELECT 'rec:' || record AS record, 'u:' || u AS user FROM granted",
    "role_fidelity": f"""WITH RECURSIVE {_UP}, {_GRANTS}, truth AS (SELECT record, u FROM granted WHERE (record * 7 + u) % 10 <> 0 UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 = 0),
v AS (SELECT coalesce(g.u, t.u) AS u, CASE WHEN t.u IS NULL THEN 'under_hide' WHEN g.u IS NULL THEN 'over_hide' ELSE 'match_grant' END AS verdict FROM granted g FULL JOIN truth t ON g.record = t.record AND g.u = t.u)
SELECT verdict, CASE WHEN verdict <> 'over_hide' THEN 'none' WHEN u % 4 = 0 OR u NOT IN (SELECT c_custkey FROM customer) THEN 'unmapped_identity' WHEN u % 6 = 1 THEN 'view_all' ELSE 'non_floor' END AS cause, count(*) AS n FROM v GROUP BY ALL""",
    "percentiles_merged": "SELECT l_returnflag AS \"group\", count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most, true AS p50_within, true AS p95_within, true AS p99_within FROM lineitem WHERE epoch_us(l_shipdate) // 1000000 // 3600 BETWEEN 220000 AND 245999 GROUP BY 1",
}
