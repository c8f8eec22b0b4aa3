"""Consolidation, quarantine and directory operators against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import consolidate as c
from quarry.operators import directory as d
from quarry.operators import resolve, service


@pytest.mark.parametrize(
    ("statement", "want"),
    [
        ("Procurement teams always need a signed DPA before the security assessment", "segment_buyer requires signed_dpa before security_review"),
        ("The security review is blocked until the SOC 2 Type II report (latest) is executed", "requires soc2_report before security_review"),
        ("An independent penetration test report is required before any vendor security evaluation.", "requires pentest vendor before security_review"),
        ("Customers tend to like maps", "segment_buyer like maps"),
        ("MAPS like customers!", "segment_buyer like maps"),
        ("", ""),
        (None, None),
        ("until", "before"),
    ],
)
def test_canonical_statement(spark, statement, want):
    row = spark.createDataFrame([(statement,)], "s string").select(c.canonical_statement(F.col("s")).alias("c")).first()
    assert row["c"] == want


def test_quarantine_settles_once(spark):
    r = random.Random(5)
    requests = [(r.randrange(30), at, r.choice(["dismiss", "reingest", "failed"]), r.choice([None, [], [1], [2, 3]])) for at in range(200)]
    want = {}
    for i in range(32):
        state, at_of, seen, refused = "open", None, None, 0
        for _, at, action, vis in sorted(x for x in requests if x[0] == i):
            if state == "open" and action == "dismiss":
                state, at_of, seen = "dismissed", at, None
            elif state == "open" and action == "reingest" and vis:
                state, at_of, seen = "reingested", at, vis
            elif state == "reingested" and action == "failed":
                state, at_of, seen = "open", None, None
            else:
                refused += 1
        want[i] = (state, at_of, seen, refused)
    items = spark.createDataFrame([(i,) for i in range(32)], "id long")
    got = d.quarantine_after(items, spark.createDataFrame(requests, "id long, at long, action string, visibility array<long>")).collect()
    assert {x.id: (x.status, x.resolved_at, x.visibility, x.refused) for x in got} == want


def test_lifecycle_query_has_every_state(spark, sf):
    from quarry.plans.directory import quarantine_lifecycle

    rows = {x.status: x for x in quarantine_lifecycle(spark, sf).collect()}
    assert set(rows) == {"open", "dismissed", "reingested"} and all(x.n > 0 for x in rows.values())


def test_split_chunks_covers_every_text(spark, sf):
    import hashlib

    from quarry.plans.ingestion import split_chunks
    from quarry.session import table
    from quarry.sources import documents

    got = {(x.id, x.seq): (x.bytes, x.sha) for x in split_chunks(spark, sf).collect()}
    texts = {x.doc_id: x.text for x in table(spark, sf, "documents").collect()}
    rows = documents.split_documents(table(spark, sf, "documents").selectExpr("doc_id AS id", "text AS content")).collect()
    assert {(x.id, x.seq): (len(x.content.encode()), hashlib.sha256(x.content.encode()).hexdigest()) for x in rows} == got
    for i, text in texts.items():  # all words, in order, in consecutive chunks
        own = [x.content for x in sorted((x for x in rows if x.id == i), key=lambda x: x.seq)]
        assert "".join("".join(own).split()) == "".join((text or "").split())


def test_percentiles_of_latency(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "operation string, ms double")
    got = service.latency(rows).first()
    assert (got.n, got.p50, got.p95, got.p99) == (100, 50.0, 95.0, 99.0)


def test_chunk_tags_need_an_anchor(spark):
    e = spark.createDataFrame(
        [("chunk:1", "canon:a", 3, "llm_mention", 1), ("chunk:2", "canon:a", 3, "llm_mention", 1), ("x:b", "chunk:2", 2, "email", 1), ("chunk:3", "canon:z", 2, "email", 1), ("chunk:4", "canon:a", 2, "email", -1)],
        "left_ref string, right_ref string, tier int, method string, polarity int",
    )
    known = spark.createDataFrame([("canon:a",), ("canon:x:b",)], "canonical string")
    assert {r.chunk: (r.tags, r.confidence) for r in resolve.chunk_tags(e, known).collect()} == {"chunk:2": (["canon:a", "canon:x:b"], "deterministic")}
    assert {r.chunk: r.tags for r in resolve.chunk_tags(e, known, auto=True).collect()} == {"chunk:1": ["canon:a"], "chunk:2": ["canon:a", "canon:x:b"]}


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quarry import session

    class Sc:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802  as Spark names it
            return None

    class Fake:
        sparkContext = Sc()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake())


def test_echo_tags_by_runs_equal_broadcast(spark, sf):
    from quarry import bindings as b

    names = spark.createDataFrame([("lang:the",), ("topic:und",), ("topic:la",), ("topic:que",), ("lang:en",), ("x:zzzz",)], "entity string")
    rows = lambda sent: sorted((r.id, r.entity) for r in resolve.echo_tags(b.chunks(spark, sf), names, 3, sent).collect())
    assert rows(100) == rows(0) != []
