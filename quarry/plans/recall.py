"""Queries of the read path: recall, traces, gates, timelines and browsing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import bindings as b
from quarry.operators import postings, reads, retrieval, vector_index
from quarry.operators import scope as sc
from quarry.session import kept, shared_dir, table

SCOPE = sc.Scope("a", (1, 2, 3, 11), ceiling=2)
BOUND = sc.Scope("a", (1, 2, 3, 4, 11, 12), ceiling=3, entities=("lang:en", "grp:0", "grp:2", "lang:fr"))
BROAD = sc.Scope("a", tuple(range(13)), ceiling=3)
FENCED = sc.Scope("a", (1, 2, 3, 4, 11, 12), ceiling=3, entities=("lang:en", "grp:0", "user:7", "user:8", "user:21"))
QUERY = [((i * 37) % 17 - 8) / 8.0 for i in range(64)]
TEXT = "the and ention of"
K = 10

_Q = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in QUERY) + "]"
_COS = f"round(list_dot_product(embedding, {_Q}) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product({_Q}, {_Q}))), 6)"


def sql_scope(s: sc.Scope, chunk: bool = True, current: bool = True) -> str:
    out = f"tenant = '{s.tenant}' AND confidentiality <= {s.ceiling} AND list_has_any(visibility, {list(s.principals)})"
    if current:
        out += " AND valid_to IS NULL"
    if s.entities:
        names = str(list(s.entities))
        out += f" AND (kind = 'knowledge' OR (len(tags) > 0 AND list_has_all({names}, tags)))" if chunk else f" AND list_contains({names}, entity_id)"
    return out


def sql_dense(s: sc.Scope, k: int) -> str:
    return f"SELECT id, {_COS} AS score FROM chunks JOIN vectors USING (id) WHERE {sql_scope(s)} ORDER BY score DESC, id LIMIT {k}"


def sql_bm25(s: sc.Scope, text: str, k: int) -> str:
    """tok, stats and df first; then the ranked rows."""
    terms = list(dict.fromkeys(text.split()))
    return f"""tok AS MATERIALIZED (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM chunks WHERE tenant = '{s.tenant}'),
dl AS (SELECT c.id, coalesce(n, 0) AS dl FROM chunks c LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) USING (id) WHERE tenant = '{s.tenant}'),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT id, t, count(*) AS tf FROM tok WHERE t IN ({', '.join(repr(t) for t in terms)}) GROUP BY id, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
bm AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (t) JOIN dl USING (id) CROSS JOIN st WHERE id IN (SELECT id FROM chunks WHERE {sql_scope(s)}) GROUP BY id ORDER BY score DESC, id LIMIT {k})"""


def recall_dense(spark, sf):
    chunks = b.chunks(spark, sf)
    hits = retrieval.dense(chunks, b.vectors(spark, sf), SCOPE, QUERY, K)
    return hits.join(chunks.select("id", "source", "document_id", "seq"), "id").select("id", "score", "source", "document_id", "seq")


_indexes: dict[str, tuple[tuple, str]] = {}


def _index(spark, sf) -> retrieval.Index:
    """The index over the chunks of a folder. It is written anew where the session or the chunks' files are others than before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{sf.rstrip('/')}/documents.parquet")
    state = where.getFileSystem(conf).getContentSummary(where)
    files = spark.sparkContext.applicationId, state.getLength(), state.getFileCount(), where.getFileSystem(conf).getFileStatus(where).getModificationTime()
    held = _indexes.get(sf)
    if held is None or held[0] != files:
        if held is not None:
            _dropped(spark, held[1])
        folder = f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}"
        retrieval.build_index(b.chunks(spark, sf), folder)
        _indexes[sf] = files, folder
    return postings.open_index(spark, _indexes[sf][1])


def _dropped(spark, folder: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(conf).delete(where, True)


def bm25_index(spark, sf):
    """What building the index from all chunks gives: numbers by tenant, and how many postings it has of how many terms."""
    folder = f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}"
    index = retrieval.build_index(b.chunks(spark, sf), folder)
    rows = index.postings.read().groupBy("tenant").agg(F.sum("n").alias("postings"), F.count_distinct("term").alias("terms")).join(index.numbers(), "tenant")
    return kept(rows)


def _changed(spark, sf):
    """The chunks as they are after some changed: every fifth has another text, every eleventh of the rest is gone."""
    chunks = b.chunks(spark, sf)
    return chunks.where("id % 5 = 0 OR id % 11 <> 0").withColumn("content", F.expr("CASE WHEN id % 5 = 0 THEN concat(replace(content, 'e', 'i'), ' the ention quarry') ELSE content END"))


def bm25_followed(spark, sf):
    """Recall after changes, from an index that followed them by segments instead of being built anew."""
    chunks, now = b.chunks(spark, sf), _changed(spark, sf)
    index = retrieval.build_index(chunks, f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}")
    touched = F.expr("id % 5 = 0 OR id % 11 = 0")
    postings.update(index, chunks.where(touched), now.where(touched))
    return retrieval.bm25(index, now, SCOPE, TEXT + " quarry", K)


def bm25_erased(spark, sf):
    """Recall after a third of the chunks was erased from the index's files, which were then merged."""
    chunks = b.chunks(spark, sf)
    index = retrieval.build_index(chunks, f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}")
    postings.erase(index, chunks.where("id % 3 = 1"))
    postings.compact(index)
    return retrieval.bm25(index, chunks.where("id % 3 <> 1"), SCOPE, TEXT, K)


def recall_bm25(spark, sf):
    return retrieval.bm25(_index(spark, sf), b.chunks(spark, sf), SCOPE, TEXT, K)


def recall_bm25_entity(spark, sf):
    return retrieval.bm25(_index(spark, sf), b.chunks(spark, sf), BOUND, TEXT, K)


def recall_hybrid_rrf(spark, sf):
    return retrieval.recall(_index(spark, sf), b.chunks(spark, sf), b.vectors(spark, sf), SCOPE, K, TEXT, QUERY)


def recall_bm25_many(spark, sf):
    """A query for every benchmark item, of its whole text."""
    asked = table(spark, sf, "benchmark").selectExpr("item_id AS qid", "text")
    return retrieval.bm25_many(_index(spark, sf), b.chunks(spark, sf), SCOPE, asked, K)


def recall_dense_many(spark, sf):
    """Every vector whose id is divisible by 100 as a query against all."""
    asked = b.vectors(spark, sf).where("id % 100 = 0").selectExpr("id AS qid", "embedding")
    return retrieval.dense_many(b.chunks(spark, sf), b.vectors(spark, sf), SCOPE, asked, K)


def recall_dense_routed(spark, sf):
    """Dense recall through the router: the narrow scope is scanned, the wide one goes to the index, here to all of its lists."""
    chunks, vectors = b.chunks(spark, sf), b.vectors(spark, sf)
    index = vector_index.build(chunks, vectors, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    legs = (("scan", SCOPE, vector_index.EXACT_BOUND), ("lists", BOUND, 0))
    found = [vector_index.recall_routed(index, chunks, vectors, s, QUERY, K, bound, probed=1.0).select(F.lit(leg).alias("leg"), "id", "score") for leg, s, bound in legs]
    return found[0].unionByName(found[1])


def recall_dense_lists(spark, sf):
    """Dense recall from the nearest quarter of the lists, with what an exact scan finds: how many of the ten are the same."""
    chunks, vectors = b.chunks(spark, sf), b.vectors(spark, sf)
    index = vector_index.build(chunks, vectors, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    near = vector_index.recall_routed(index, chunks, vectors, BROAD, QUERY, K, bound=0)
    exact = retrieval.dense(chunks, vectors, BROAD, QUERY, K).select("id", F.lit(True).alias("exact"))
    return near.join(exact, "id", "left").select("id", "score", F.coalesce("exact", F.lit(False)).alias("exact"))


def recall_composite(spark, sf):
    chunks = b.chunks(spark, sf)
    hits = retrieval.dense(chunks, b.vectors(spark, sf), SCOPE, QUERY, 50).join(chunks.selectExpr("id", "valid_from AS at", "CAST(1 + id % 3 AS INT) AS trust_tier", "CASE WHEN id % 4 = 0 THEN 1.5D END AS importance", "CASE WHEN id % 6 = 0 THEN 'fact' ELSE 'chunk' END AS kind"), "id")
    return retrieval.composite(hits, NOW).select("id", "rank_score")


def debug_trace(spark, sf):
    return retrieval.debug_trace(b.chunks(spark, sf), b.vectors(spark, sf), BOUND, QUERY, 50)


BEATS = [("src0", b.BASE), ("src1", b.BASE + 90 * b.DAY), ("src2", None), ("src3", b.BASE + 99 * b.DAY)]
NOW = b.BASE + 100 * b.DAY


def freshness_gate(spark, sf):
    chunks = b.chunks(spark, sf)
    hits = retrieval.dense(chunks, b.vectors(spark, sf), SCOPE, QUERY, 2 * K).join(chunks.select("id", "source"), "id")
    beats = spark.createDataFrame(BEATS, "source string, last_seen long")
    return retrieval.freshness_gate(hits, beats, NOW, 5 * b.DAY, K)


def latest_chunks(spark, sf):
    return reads.latest_chunks(b.chunks(spark, sf), SCOPE, "lang:en", 20).select("id", "source", "valid_from")


def activity_timeline(spark, sf):
    return reads.activity(b.actions(spark, sf), SCOPE, None, b.BASE + 3 * b.DAY, ["view.low", "purchase.*"], None, 50).select("action_id", "actor", "action_type", "occurred_at")


def activity_of_entity(spark, sf):
    return reads.activity(b.actions(spark, sf), SCOPE, "user:7", None, None, ["actor:7"], 50).select("action_id", "action_type", "occurred_at")


def _memories(spark, sf, scope, **filters):
    return reads.memories(b.chunks(spark, sf), b.fact_events(spark, sf).withColumnRenamed("arrival", "id"), b.actions(spark, sf), scope, **filters)


def memories_browse(spark, sf):
    return reads.page(_memories(spark, sf, SCOPE), 25, after=(b.BASE + 20 * b.DAY, "chunk", 300))


def memories_bound(spark, sf):
    """A bound scope's view: chunks, facts and actions all within its entities."""
    return _memories(spark, sf, FENCED, text="E").groupBy("kind", "entities").agg(F.count("*").alias("n"), F.count_if("truncated").alias("n_truncated"))


def memories_history(spark, sf):
    return reads.page(_memories(spark, sf, SCOPE, kind="chunk", entity="lang:en", history=True), 40)


def memories_by_source(spark, sf):
    return _memories(spark, sf, SCOPE).groupBy("source").count().withColumnRenamed("count", "n")


def brief_visibility(spark, sf):
    return reads.brief_sources(b.chunks(spark, sf), b.actions(spark, sf), "a", 10)


def entity_tags(spark, sf):
    return reads.entity_tags(b.chunks(spark, sf), b.actions(spark, sf), "a")


def _mem(s: sc.Scope, current: bool = True) -> str:
    names = list(s.entities)
    fact = f" AND list_contains({names}, entity_id)" if names else ""
    act = f" AND list_has_any(entities, {names})" if names else ""
    plain = sc.Scope(s.tenant, s.principals, s.ceiling)
    none = "CAST(NULL AS VARCHAR) AS entity_id, CAST(NULL AS VARCHAR) AS field"
    return f"""memories AS (
  SELECT 'chunk' AS kind, id, source, valid_from AS recorded_at, left(content, 240) AS preview, length(content) > 240 AS truncated, array_to_string(tags, ',') AS entities, CAST(len(visibility) AS INT) AS visible_to, confidentiality, {none}, document_id, seq, CAST(NULL AS VARCHAR) AS action_type, valid_to, tags AS names, content AS said FROM chunks WHERE {sql_scope(s, current=current)}
  UNION ALL SELECT 'fact', arrival, source, valid_from, left(coalesce(value, ''), 240), length(coalesce(value, '')) > 240, source || ':' || entity_id, len(visibility), confidentiality, entity_id, field, NULL, NULL, NULL, NULL, [source || ':' || entity_id], coalesce(value, '') FROM fact_events WHERE {sql_scope(plain, current=False)}{fact}
  UNION ALL SELECT 'action', action_id, 'agent', occurred_at, left(summary, 240), length(summary) > 240, array_to_string(entities, ','), len(visibility), confidentiality, NULL, NULL, NULL, NULL, action_type, NULL, entities, summary FROM actions WHERE {sql_scope(plain, current=False)}{act})"""


_BASE = b.CTE["chunks"].replace("chunks AS", "base AS", 1)

QUERIES = {f.__name__: f for f in (recall_dense, recall_bm25, recall_bm25_entity, recall_hybrid_rrf, recall_bm25_many, bm25_index, bm25_followed, bm25_erased, recall_dense_many, recall_dense_routed, recall_dense_lists, recall_composite, debug_trace, freshness_gate, latest_chunks, activity_timeline, activity_of_entity, memories_browse, memories_bound, memories_history, memories_by_source, brief_visibility, entity_tags)}

ORACLE_SQL = {
    "recall_dense": b.sql("chunks", "vectors", then=f" SELECT id, score, source, document_id, seq FROM ({sql_dense(SCOPE, K)}) JOIN chunks USING (id)"),
    "recall_bm25": b.sql("chunks", then=f",\n{sql_bm25(SCOPE, TEXT, K)} SELECT id, score FROM bm"),
    "recall_dense_routed": b.sql("chunks", "vectors", then=f" SELECT 'scan' AS leg, * FROM ({sql_dense(SCOPE, K)}) UNION ALL SELECT 'lists', * FROM ({sql_dense(BOUND, K)})"),
    "bm25_index": b.sql("chunks", then=""", w AS (SELECT tenant, id, unnest(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM chunks),
u AS (SELECT tenant, count(DISTINCT (id, t)) AS postings, count(DISTINCT t) AS terms, count(*) AS total FROM w GROUP BY 1), c AS (SELECT tenant, count(*) AS n FROM chunks GROUP BY 1) SELECT tenant, postings, terms, n, total FROM u JOIN c USING (tenant)"""),
    "bm25_followed": f"""WITH {_BASE}, chunks AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN replace(content, 'e', 'i') || ' the ention quarry' ELSE content END AS content) FROM base WHERE id % 5 = 0 OR id % 11 <> 0),
{sql_bm25(SCOPE, TEXT + ' quarry', K)} SELECT id, score FROM bm""",
    "bm25_erased": f"WITH {_BASE}, chunks AS (SELECT * FROM base WHERE id % 3 <> 1),\n{sql_bm25(SCOPE, TEXT, K)} SELECT id, score FROM bm",
    "recall_bm25_entity": b.sql("chunks", then=f",\n{sql_bm25(BOUND, TEXT, K)} SELECT id, score FROM bm"),
    "recall_hybrid_rrf": b.sql("chunks", "vectors", then=f""",
{sql_bm25(SCOPE, TEXT, K)}, de AS ({sql_dense(SCOPE, K)}),
legs AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM de)
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM legs GROUP BY id ORDER BY score DESC, id LIMIT {K}"""),
    "recall_bm25_many": b.sql("chunks", then=f""",
tok AS MATERIALIZED (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM chunks WHERE tenant = 'a'),
dl AS (SELECT c.id, coalesce(n, 0) AS dl FROM chunks c LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) USING (id) WHERE tenant = 'a'), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM benchmark),
tf AS (SELECT id, t, count(*) AS tf FROM tok WHERE t IN (SELECT t FROM q) GROUP BY id, t), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
sc AS (SELECT id, t, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM tf JOIN df USING (t) JOIN dl USING (id) CROSS JOIN st WHERE id IN (SELECT id FROM chunks WHERE {sql_scope(SCOPE)})),
r AS (SELECT qid, id, round(sum(s), 6) AS score FROM sc JOIN q USING (t) GROUP BY 1, 2) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= {K}"""),
    "recall_dense_many": b.sql("chunks", "vectors", then=f""", q AS (SELECT id AS qid, embedding AS e FROM vectors WHERE id % 100 = 0), v AS (SELECT id, embedding FROM vectors WHERE id IN (SELECT id FROM chunks WHERE {sql_scope(SCOPE)})),
r AS (SELECT qid, id, round(list_dot_product(embedding, e) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(e, e))), 6) AS score FROM v CROSS JOIN q) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= {K}"""),
    "recall_composite": b.sql("chunks", "vectors", then=f", h AS ({sql_dense(SCOPE, 50)}) SELECT id, round(score * CASE WHEN id % 6 = 0 THEN 1.0::DOUBLE ELSE pow(0.5::DOUBLE, ({NOW} - valid_from) / (30 * 86400)::DOUBLE) END * CASE id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END * CASE WHEN id % 4 = 0 THEN 1.5::DOUBLE ELSE 1 END, 6) AS rank_score FROM h JOIN chunks USING (id)"),
    "debug_trace": b.sql("chunks", "vectors", then=f""", top AS (SELECT *, {_COS} AS score FROM chunks JOIN vectors USING (id) WHERE tenant = 'a' ORDER BY score DESC, id LIMIT 50)
SELECT id, score, array_to_string(list_sort(list_filter([
  CASE WHEN valid_to IS NOT NULL THEN 'stale_superseded' END, CASE WHEN len(visibility) = 0 THEN 'visibility_empty' END,
  CASE WHEN len(visibility) > 0 AND NOT list_has_any(visibility, {list(BOUND.principals)}) THEN 'visibility_no_overlap' END,
  CASE WHEN confidentiality > {BOUND.ceiling} THEN 'confidentiality_above_ceiling' END,
  CASE WHEN kind <> 'knowledge' AND len(tags) = 0 THEN 'entity_scope_untagged' END,
  CASE WHEN kind <> 'knowledge' AND len(tags) > 0 AND NOT list_has_all({list(BOUND.entities)}, tags) THEN 'entity_scope_outside' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM top"""),
    "freshness_gate": b.sql("chunks", "vectors", then=f""", beats(source, last_seen) AS (VALUES ('src0', {BEATS[0][1]}), ('src1', {BEATS[1][1]}), ('src2', NULL), ('src3', {BEATS[3][1]})),
hits AS (SELECT id, score, source FROM ({sql_dense(SCOPE, 2 * K)}) JOIN chunks USING (id)),
v AS (SELECT id, h.source, score, CASE WHEN b.source IS NULL THEN 'exempt' WHEN last_seen IS NULL THEN 'never_synced' WHEN {NOW} - last_seen <= {5 * b.DAY} THEN 'fresh' ELSE 'stale' END AS verdict FROM hits h LEFT JOIN beats b ON h.source = b.source)
SELECT * FROM v WHERE verdict IN ('exempt', 'fresh') ORDER BY score DESC, id LIMIT {K}"""),
    "latest_chunks": b.sql("chunks", then=f" SELECT id, source, valid_from FROM chunks WHERE {sql_scope(SCOPE)} AND list_contains(tags, 'lang:en') ORDER BY valid_from DESC, id DESC LIMIT 20"),
    "activity_timeline": b.sql("actions", then=f" SELECT action_id, actor, action_type, occurred_at FROM actions WHERE {sql_scope(SCOPE, current=False)} AND occurred_at >= {b.BASE + 3 * b.DAY} AND (action_type = 'view.low' OR action_type LIKE 'purchase.%') ORDER BY occurred_at DESC, action_id DESC LIMIT 50"),
    "activity_of_entity": b.sql("actions", then=f" SELECT action_id, action_type, occurred_at FROM actions WHERE {sql_scope(SCOPE, current=False)} AND list_contains(entities, 'user:7') AND actor = 'actor:7' ORDER BY occurred_at DESC, action_id DESC LIMIT 50"),
    "memories_browse": b.sql("chunks", "fact_events", "actions", then=f",\n{_mem(SCOPE)}, r AS (SELECT * EXCLUDE (names, said), row_number() OVER (ORDER BY recorded_at DESC, kind DESC, id DESC) AS k, count(*) OVER () AS n FROM memories WHERE (recorded_at, kind, id) < ({b.BASE + 20 * b.DAY}, 'chunk', 300)) SELECT * EXCLUDE (k, n), n > 25 AS has_more FROM r WHERE k <= 25"),
    "memories_bound": b.sql("chunks", "fact_events", "actions", then=f",\n{_mem(FENCED)} SELECT kind, entities, count(*) AS n, count(*) FILTER (truncated) AS n_truncated FROM memories WHERE contains(lower(said), 'e') GROUP BY ALL"),
    "memories_history": b.sql("chunks", "fact_events", "actions", then=f",\n{_mem(SCOPE, False)}, r AS (SELECT * EXCLUDE (names, said), row_number() OVER (ORDER BY recorded_at DESC, kind DESC, id DESC) AS k, count(*) OVER () AS n FROM memories WHERE kind = 'chunk' AND list_contains(names, 'lang:en')) SELECT * EXCLUDE (k, n), n > 40 AS has_more FROM r WHERE k <= 40"),
    "memories_by_source": b.sql("chunks", "fact_events", "actions", then=f",\n{_mem(SCOPE)} SELECT source, count(*) AS n FROM memories GROUP BY source"),
    "brief_visibility": b.sql("chunks", "actions", then=""", items AS (
  SELECT entity, 'chunk' AS kind, id, valid_from AS seen_at, visibility FROM (SELECT *, unnest(tags) AS entity FROM chunks WHERE tenant = 'a' AND valid_to IS NULL)
  UNION ALL SELECT entity, 'action', action_id, occurred_at, visibility FROM (SELECT *, unnest(entities) AS entity FROM actions WHERE tenant = 'a')),
top AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY entity, kind ORDER BY seen_at DESC, id DESC) <= 10),
f AS (SELECT entity, count(*) AS n, list(visibility) AS vs FROM top GROUP BY entity)
SELECT entity, n AS n_sources, array_to_string(list_sort(list_reduce(vs, lambda x, y: list_intersect(x, y))), ',') AS source_visibility FROM f"""),
    "entity_tags": b.sql("chunks", "actions", then=""", u AS (
  SELECT unnest(tags) AS entity, valid_to IS NULL AS live, 1 AS c, 0 AS a, valid_from AS seen_at FROM chunks WHERE tenant = 'a'
  UNION ALL SELECT unnest(entities), false, 0, 1, occurred_at FROM actions WHERE tenant = 'a')
SELECT entity, split_part(entity, ':', 1) AS namespace, CAST(sum(CASE WHEN live THEN c ELSE 0 END) AS BIGINT) AS live_chunks, CAST(sum(c) AS BIGINT) AS chunks, CAST(sum(a) AS BIGINT) AS actions, max(seen_at) AS last_seen FROM u GROUP BY entity"""),
}
