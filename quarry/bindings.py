"""The driver's tables seen as the governed model, for Spark and for DuckDB.

Access rules, tags and histories are derived by arithmetic on the keys, so
both engines build the same rows. Each binding has a Spark function and a
common table expression of the same name in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import table

DAY = 86_400
BASE = 1_704_067_200  # 2024-01-01, where events begin
SECONDS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {0}) div 1000000"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "CASE WHEN doc_id % 10 = 9 THEN 'b' ELSE 'a' END AS tenant",
        "doc_id AS id",
        "source",
        "doc_id div 3 AS document_id",
        "CAST(doc_id % 3 AS INT) AS seq",
        "text AS content",
        "CASE WHEN doc_id % 29 = 0 THEN CAST(array() AS array<bigint>) ELSE array(doc_id % 7, 10 + doc_id % 3) END AS visibility",
        "CAST(doc_id % 4 AS INT) AS confidentiality",
        "CASE WHEN doc_id % 13 = 0 THEN CAST(array() AS array<string>) WHEN doc_id % 3 = 0 THEN array('lang:' || lang, 'grp:' || (doc_id % 5)) ELSE array('lang:' || lang) END AS tags",
        "CASE WHEN doc_id % 17 = 0 THEN 'knowledge' ELSE 'document' END AS kind",
        f"{BASE} + doc_id * 3600 AS valid_from",
        f"CASE WHEN doc_id % 11 = 0 THEN {BASE} + doc_id * 3600 + {DAY} END AS valid_to",
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS embedding", "label")


def fact_events(spark: SparkSession, sf: str) -> DataFrame:
    """Change events in order of arrival; every seventh is a day and a half late."""
    return table(spark, sf, "events").selectExpr(
        "'a' AS tenant",
        "event_type AS source",
        "'user:' || user_id AS entity_id",
        "'k' AS field",
        "get_json_object(props, '$.k') AS value",
        f"{SECONDS.format('ts')} - CASE WHEN event_id % 7 = 0 THEN {DAY + DAY // 2} ELSE 0 END AS valid_from",
        "event_id AS arrival",
        "array(user_id % 7, 10 + user_id % 3) AS visibility",
        "CAST(user_id % 4 AS INT) AS confidentiality",
    )


def actions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "CASE WHEN event_id % 10 = 9 THEN 'b' ELSE 'a' END AS tenant",
        "event_id AS action_id",
        "'actor:' || (user_id % 20) AS actor",
        "event_type || '.' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS action_type",
        "array('user:' || user_id, 'type:' || event_type) AS entities",
        "event_type || ' by user ' || user_id AS summary",
        f"{SECONDS.format('ts')} AS occurred_at",
        "array(event_id % 7, 10 + event_id % 3) AS visibility",
        "CAST(event_id % 4 AS INT) AS confidentiality",
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Freshness samples: an order's date and its lines' shipping dates."""
    line, order = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return line.join(order, line["l_orderkey"] == order["o_orderkey"]).selectExpr("o_orderpriority AS source", f"{SECONDS.format('o_orderdate')} AS event_at", f"{SECONDS.format('l_shipdate')} AS queryable_at")


_E = "epoch_us({0}) // 1000000"

CTE = {
    "chunks": f"""chunks AS (SELECT CASE WHEN doc_id % 10 = 9 THEN 'b' ELSE 'a' END AS tenant, doc_id AS id, source, doc_id // 3 AS document_id, CAST(doc_id % 3 AS INT) AS seq, text AS content,
  CASE WHEN doc_id % 29 = 0 THEN CAST([] AS BIGINT[]) ELSE [doc_id % 7, 10 + doc_id % 3] END AS visibility, CAST(doc_id % 4 AS INT) AS confidentiality,
  CASE WHEN doc_id % 13 = 0 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 3 = 0 THEN ['lang:' || lang, 'grp:' || (doc_id % 5)] ELSE ['lang:' || lang] END AS tags,
  CASE WHEN doc_id % 17 = 0 THEN 'knowledge' ELSE 'document' END AS kind, {BASE} + doc_id * 3600 AS valid_from,
  CASE WHEN doc_id % 11 = 0 THEN {BASE} + doc_id * 3600 + {DAY} END AS valid_to FROM documents)""",
    "vectors": "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)",
    "fact_events": f"""fact_events AS (SELECT 'a' AS tenant, event_type AS source, 'user:' || user_id AS entity_id, 'k' AS field, json_extract_string(props, '$.k') AS value,
  {_E.format('ts')} - CASE WHEN event_id % 7 = 0 THEN {DAY + DAY // 2} ELSE 0 END AS valid_from, event_id AS arrival, [user_id % 7, 10 + user_id % 3] AS visibility, CAST(user_id % 4 AS INT) AS confidentiality FROM events)""",
    "actions": f"""actions AS (SELECT CASE WHEN event_id % 10 = 9 THEN 'b' ELSE 'a' END AS tenant, event_id AS action_id, 'actor:' || (user_id % 20) AS actor,
  event_type || '.' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS action_type, ['user:' || user_id, 'type:' || event_type] AS entities, event_type || ' by user ' || user_id AS summary,
  {_E.format('ts')} AS occurred_at, [event_id % 7, 10 + event_id % 3] AS visibility, CAST(event_id % 4 AS INT) AS confidentiality FROM events)""",
    "samples": f"samples AS (SELECT o_orderpriority AS source, {_E.format('o_orderdate')} AS event_at, {_E.format('l_shipdate')} AS queryable_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
}


def sql(*names: str, then: str) -> str:
    """A query over bindings: their CTEs, then the rest (which may begin with further CTEs)."""
    return "WITH " + ",\n".join(CTE[n] for n in names) + then
