"""Queries that run a stream over what is there and return what it wrote."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from quarry import bindings as b
from quarry.operators import scope as sc
from quarry.plans import temporal
from quarry.plans.recall import SCOPE, sql_scope
from quarry.streaming import facts as stream_facts
from quarry.session import table
from quarry.sources import cdc, connector
from quarry.streaming import acl, membership
from quarry.streaming import subscribe as sub
from quarry.streaming import watch


class _Streams:
    """Stands in for a session where a binding reads tables, so bindings serve streams as well."""

    def __init__(self, spark):
        self.read = self
        self._spark = spark

    def parquet(self, path):
        return sub.stream_table(self._spark, path)


def stream_cdc(spark, sf):
    folder = sub.run_once(stream_facts.fact_log(b.fact_events(_Streams(spark), sf)), "cdc")
    return stream_facts.versions_of(spark.read.schema(stream_facts.LOG).parquet(folder))


def stream_subscribe(spark, sf):
    """A subscription: every batch's rows as its scope, compiled then, lets them through."""
    from quarry.session import shared_dir

    base = f"{shared_dir(spark)}/subscribe-{uuid.uuid4().hex}"
    deliver = lambda rows, number: rows.select("action_id", "actor", "action_type", "occurred_at").write.mode("overwrite").parquet(f"{base}/out/batch={number}")
    sub.subscribe(b.actions(_Streams(spark), sf), lambda: SCOPE, deliver, f"{base}/state", lambda: acl.fenced(b.BASE, b.BASE + 5, 60)).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("action_id", "actor", "action_type", "occurred_at")


def subscription_polls(spark, sf):
    """Three polls of 256 rows; between the first and the second a principal is revoked, before the third a group is."""
    rows, mark, out = b.actions(spark, sf), sub.START, None
    for number, principals in enumerate(_POLLS):
        page, mark = sub.poll(rows, replace(SCOPE, principals=principals), mark)
        page = page.select(F.lit(number).alias("poll"), "action_id", "occurred_at")
        out = page if out is None else out.unionByName(page)
    return out


def stream_windows(spark, sf):
    """Tumbling windows with a watermark, over event time."""
    from quarry.session import table

    rows = table(_Streams(spark), sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = rows.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("day"), "event_type", "n")
    return spark.read.schema(out.schema).parquet(sub.run_once(out, "windows"))


_ENVELOPE = "'{\"op\":\"' || CASE WHEN o_orderkey % 11 = 0 THEN 'd' ELSE 'u' END || '\",\"source\":{\"connector\":\"pg\",\"db\":\"crm\",\"schema\":\"s\",\"table\":\"t' || (o_orderkey % 700 % 3) || '\",\"ts_ms\":' || (1700000000000 + o_orderkey * 1000) || '},\"before\":{\"id\":' || (o_orderkey % 700) || '},\"after\":{\"id\":' || (o_orderkey % 700) || ',\"status\":\"' || o_orderstatus || '\",\"prio\":\"' || o_orderpriority || '\"}' || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE ',\"acl\":{\"visibility\":[1,2]}' END || '}'"


def stream_cdc_driver(spark, sf):
    """Envelopes, every third delivery an array of one, through the driver; then what the run did."""
    from quarry.session import shared_dir, table

    raw = table(_Streams(spark), sf, "orders").selectExpr("o_orderkey AS arrival", f"CASE WHEN o_orderkey % 3 = 0 THEN '[' || {_ENVELOPE} || ']' ELSE {_ENVELOPE} END AS body")
    folder = f"{shared_dir(spark)}/cdc-{uuid.uuid4().hex}"
    cdc.ingest(raw, folder, f"{folder}/state").awaitTermination()
    return cdc.run_report(spark.read.parquet(f"{folder}/events"))


def stream_watch(spark, sf):
    """Membership changes as they come, those seen lately left out, and whether any was missed."""
    rows = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 500 <> 7").selectExpr("event_id AS seq", "'u:' || (user_id % 40) AS member", "'g:' || (event_id % 5) AS parent", "event_id * 30 AS at")
    out = watch.watched(rows, 6000)
    return out.groupBy("degraded", "fresh").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


#: Seconds within which a token is not revoked again, here.
_AGAIN = 3600


def _groups(spark, sf):
    """Nations are in regions, regions in the world; the groups that were ever granted anything have tokens."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    edges = nation.selectExpr("'nation:' || n_nationkey AS member", "'region:' || n_regionkey AS parent").unionByName(region.selectExpr("'region:' || r_regionkey AS member", "'world' AS parent"))
    tokens = nation.selectExpr("'nation:' || n_nationkey AS principal", "n_nationkey AS token").where("token % 6 <> 5").unionByName(region.selectExpr("'region:' || r_regionkey AS principal", "100 + r_regionkey AS token"))
    return edges, tokens.selectExpr("principal", "CAST(token AS LONG) AS token").unionByName(spark.createDataFrame([("world", 200)], "principal string, token long"))


def watch_tombstones(spark, sf):
    """Every removal of a user from a nation revokes the nation's token, its region's and the world's, but not twice within an hour."""
    edges, tokens = _groups(spark, sf)
    removals = table(_Streams(spark), sf, "events").selectExpr("event_id AS seq", "CASE WHEN event_id % 97 <> 0 THEN 'user:' || user_id END AS member", "'nation:' || (user_id % 25) AS parent", "CAST(unix_micros(CAST(ts AS TIMESTAMP)) div 1000000 AS LONG) AS at")
    folder = sub.run_once(membership.tombstones(removals, edges, tokens, window=_AGAIN), "tombstones", idle=False)
    return spark.read.schema(membership.TOMBSTONES).parquet(folder)


def watch_degraded(spark, sf):
    """When the feeds of five brokers were degraded: each loses a change now and then and is resynced some time later."""
    changes = table(_Streams(spark), sf, "events").where("event_id div 5 % 211 <> 17").selectExpr("'broker:' || (event_id % 5) AS feed", "event_id div 5 AS seq", "event_id div 5 % 400 = 0 AS resync")
    folder = sub.run_once(membership.feed_events(changes), "feeds")
    return membership.degraded(spark.read.schema(membership.FEED).parquet(folder))


def _event_rows(spark, sf):
    """Events of a connector: facts of orders; a share that could not be mapped now and then."""
    return table(spark, sf, "orders").selectExpr(
        "'fact' AS kind", "'shop' AS source", "'order:' || o_orderkey AS entity_id", "'status' AS field", "o_orderstatus AS value", "CAST(o_orderkey * 60 AS LONG) AS valid_from", "CAST(NULL AS STRING) AS content", "CAST(NULL AS STRING) AS mime_type", "CAST(NULL AS STRING) AS version",
        "o_orderkey % 17 <> 0 AS resolvable", "array('cust:' || o_custkey) AS principals", "array('prio:' || o_orderpriority) AS groups", "array() AS tags", "o_orderkey div 2000 AS page",
    )


def connector_resumed(spark, sf):
    """A connector's pages as a stream: some of them, then, from the checkpoint, those that came later; each row once."""
    from quarry.session import shared_dir

    base = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    rows = _event_rows(spark, sf)
    half = rows.agg(F.max("page")).head()[0] // 2
    connector.write_pages(rows.where(F.col("page") <= half), "page", f"{base}/in")
    out = sub.run_once(connector.pages(spark, f"{base}/in", stream=True), "connector", f"{base}/state", f"{base}/out")
    connector.write_pages(rows.where(F.col("page") > half), "page", f"{base}/in")
    sub.run_once(connector.pages(spark, f"{base}/in", stream=True), "connector", f"{base}/state", out)
    taken, held = connector.admitted(spark.read.schema(connector.EVENTS).parquet(out))
    return taken.withColumn("indexed", F.lit(True)).unionByName(held.withColumn("indexed", F.lit(False))).select("entity_id", "value", "valid_from", "indexed", F.element_at("principals", 1).alias("principal"))


def connector_poll(spark, sf):
    """The pages behind a cursor, as a batch, by source."""
    from quarry.session import shared_dir

    base = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    connector.write_pages(_event_rows(spark, sf), "page", base)
    return connector.pages(spark, base, cursor="page=000000000001").groupBy("value").agg(F.count("*").alias("n"), F.min("valid_from").alias("first"), F.count_if(~F.col("resolvable")).alias("quarantined"))


_POLLS = ((1, 2, 3, 11), (1, 3, 11), (1, 3))


def _polls_sql() -> str:
    parts = []
    for n, principals in enumerate(_POLLS):
        later = f" AND (occurred_at, action_id) > (SELECT (max(occurred_at), arg_max(action_id, (occurred_at, action_id))) FROM p{n - 1})" if n else ""
        parts.append(f"p{n} AS (SELECT {n} AS poll, action_id, occurred_at FROM actions WHERE {sql_scope(replace(SCOPE, principals=principals), current=False)}{later} ORDER BY occurred_at, action_id LIMIT 256)")
    return b.sql("actions", then=", " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM p{n}" for n in range(len(_POLLS))))


QUERIES = {q.__name__: q for q in (subscription_polls, watch_tombstones, watch_degraded, connector_resumed, connector_poll, stream_cdc_driver, stream_watch, stream_cdc, stream_subscribe, stream_windows)}

ORACLE_SQL = {
    "subscription_polls": _polls_sql(),
    "watch_tombstones": f"""WITH RECURSIVE e AS (SELECT event_id AS seq, CASE WHEN event_id % 97 <> 0 THEN 'user:' || user_id ELSE 'watch:unresolved-member' END AS member, user_id % 25 AS n, epoch_us(ts) // 1000000 AS at_s FROM events),
l AS (SELECT n AS token, 'nation:' || n AS principal, seq, member, at_s FROM e WHERE n % 6 <> 5 UNION ALL SELECT 100 + n_regionkey, 'region:' || n_regionkey, seq, member, at_s FROM e JOIN nation ON n_nationkey = n UNION ALL SELECT 200, 'world', seq, member, at_s FROM e),
f AS MATERIALIZED (SELECT token, principal, at_s, min(seq) AS seq, arg_min(member, seq) AS member FROM l GROUP BY ALL),
t AS (SELECT token, principal, min(seq) AS seq, arg_min(member, seq) AS member, at_s FROM f WHERE (token, at_s) IN (SELECT (token, min(at_s)) FROM f GROUP BY token) GROUP BY token, principal, at_s
  UNION ALL SELECT token, principal, seq, member, at_s FROM (SELECT f.*, row_number() OVER (PARTITION BY f.token ORDER BY f.at_s) AS r FROM t JOIN f ON f.token = t.token AND f.at_s > t.at_s + {_AGAIN}) WHERE r = 1)
SELECT CAST(token AS BIGINT) AS token, principal, seq, member, at_s AS "at" FROM t""",
    "watch_degraded": """WITH c AS (SELECT 'broker:' || (event_id % 5) AS feed, event_id // 5 AS seq FROM events WHERE event_id // 5 % 211 <> 17),
g AS (SELECT *, seq - lag(seq) OVER (PARTITION BY feed ORDER BY seq) > 1 AS gap FROM c), x AS (SELECT feed, seq, CAST(sum(CASE WHEN seq % 400 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY seq) AS INT) - CASE WHEN seq % 400 = 0 THEN 1 ELSE 0 END AS term, gap FROM g),
b AS (SELECT feed, term, min(seq) AS since FROM x WHERE gap GROUP BY ALL), r AS (SELECT feed, term, min(seq) AS until FROM x WHERE seq % 400 = 0 GROUP BY ALL) SELECT feed, since, until FROM b LEFT JOIN r USING (feed, term)""",
    "connector_resumed": "SELECT 'order:' || o_orderkey AS entity_id, o_orderstatus AS value, o_orderkey * 60 AS valid_from, o_orderkey % 17 <> 0 AS indexed, 'cust:' || o_custkey AS principal FROM orders",
    "connector_poll": "SELECT o_orderstatus AS value, count(*) AS n, min(o_orderkey) * 60 AS first, count(*) FILTER (o_orderkey % 17 = 0) AS quarantined FROM orders WHERE o_orderkey // 2000 > 1 GROUP BY 1",
    # times follow arrival here, so the value before is the current one
    "stream_cdc_driver": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 700 AS ent, o_orderkey % 11 = 0 AS del, o_orderkey % 13 <> 0 AS ok, o_orderstatus AS status, o_orderpriority AS prio FROM orders),
f AS (SELECT k, ent, 'status' AS field, status AS v FROM o WHERE NOT del AND ok UNION ALL SELECT k, ent, 'prio', prio FROM o WHERE NOT del AND ok),
e AS (SELECT k, ent, field, v, false AS gone FROM f UNION ALL SELECT o.k, o.ent, x.field, NULL, true FROM o JOIN (SELECT DISTINCT ent, field FROM f) x USING (ent) WHERE del),
l AS (SELECT *, lag(v) OVER w AS before, coalesce(lag(gone) OVER w, true) AS fresh FROM e WINDOW w AS (PARTITION BY ent, field ORDER BY k)),
c AS (SELECT 'pg:crm.s.t' || (ent % 3) AS source, count(*) FILTER (NOT gone AND fresh) AS inserted, count(*) FILTER (NOT gone AND NOT fresh AND v <> before) AS superseded, CAST(0 AS BIGINT) AS stale, count(*) FILTER (NOT gone AND NOT fresh AND v = before) AS unchanged, count(*) FILTER (gone AND NOT fresh) AS retired FROM l GROUP BY 1),
r AS (SELECT 'pg:crm.s.t' || (ent % 3) AS source, 2 * count(*) AS refused FROM o WHERE NOT del AND NOT ok GROUP BY 1) SELECT c.*, CAST(coalesce(refused, 0) AS BIGINT) AS refused FROM c LEFT JOIN r USING (source)""",
    "stream_watch": """WITH c AS (SELECT event_id AS seq, user_id % 40 AS m, event_id % 5 AS p, event_id * 30 AS at_s FROM events WHERE event_id % 500 <> 7),
g AS (SELECT *, coalesce(seq - lag(seq) OVER (ORDER BY seq) > 1, false) AS gap, coalesce(at_s - lag(at_s) OVER (PARTITION BY m, p ORDER BY seq) < 6000, false) AS again FROM c), d AS (SELECT *, bool_or(gap) OVER (ORDER BY seq) AS degraded FROM g)
SELECT degraded, NOT again AS fresh, count(*) AS n, min(seq) AS first_seq FROM d GROUP BY ALL""",
    "stream_cdc": temporal.ORACLE_SQL["fact_state_machine"],
    "stream_subscribe": b.sql("actions", then=f" SELECT action_id, actor, action_type, occurred_at FROM actions WHERE {sql_scope(SCOPE, current=False)}"),
    # a window is written once the watermark, an hour behind the newest event, has passed its end
    "stream_windows": "WITH d AS (SELECT epoch_us(ts) // 1000000 // 86400 * 86400 AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT day, event_type, n FROM d WHERE day + 86400 <= (SELECT max(epoch_us(ts)) / 1000000 - 3600 FROM events)",
}
