"""Scopes: random scopes and rows against the predicate written out in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import access, facts, graph, knowledge, reads, resolve, retrieval
from quarry.operators import scope as sc
from quarry.schema import CHUNKS, acl_label, confidentiality
from quarry.sources import cdc, connectors, documents, manifest


def rows_of(seed: int, n: int = 120):
    r = random.Random(seed)
    tags = ["crm:a", "crm:b", "crm:c", "lang:en"]
    return [(r.choice("ab"), i, r.choice(["s1", "s2"]), i // 3, i % 3, r.choice(["", "the word", "word and word", None]), r.sample(range(6), r.randint(0, 3)), r.randint(0, 3), r.sample(tags, r.randint(0, 2)), r.choice(["document", "document", "knowledge"]), i, None if r.random() < 0.7 else i + 5) for i in range(n)]


def seen(row, s: sc.Scope) -> bool:
    tenant, _, _, _, _, _, visibility, level, tags, kind, _, valid_to = row
    fence = not s.entities or kind == "knowledge" or (bool(tags) and set(tags) <= set(s.entities))
    return bool(s.principals) and tenant == s.tenant and valid_to is None and bool(set(visibility) & set(s.principals)) and level <= s.ceiling and fence


def scopes(seed: int, n: int):
    r = random.Random(seed)
    for _ in range(n):
        yield sc.Scope(r.choice("ab"), tuple(r.sample(range(7), r.randint(0, 3))), r.randint(0, 3), tuple(r.sample(["crm:a", "crm:b", "crm:c", "lang:en"], r.randint(0, 3))))


def test_scope_fuzz(spark, tmp_path):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, CHUNKS).cache()
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(120)], "id long, embedding array<double>").cache()
    index = retrieval.build_index(df, str(tmp_path))
    for k, s in enumerate(scopes(2, 25)):
        want = {row[1] for row in rows if seen(row, s)}
        assert {x["id"] for x in sc.scoped_chunks(df, s).select("id").collect()} == want, s
        if k % 5 == 0:
            assert {x["id"] for x in retrieval.dense(df, vectors, s, [1.0, 0.5], 1000).collect()} == want
            assert {x["id"] for x in retrieval.bm25(index, df, s, "word", 1000).collect()} == {row[1] for row in rows if row[1] in want and "word" in (row[5] or "")}
            reasons = {x["id"]: x["reasons"] for x in retrieval.debug_trace(df, vectors, s, [1.0, 0.5], 1000).collect()}
            assert all((reasons[row[1]] == "") == seen(row, s) for row in rows if row[0] == s.tenant and s.principals)


def test_no_principals_reads_nothing(spark):
    df = spark.createDataFrame(rows_of(3), CHUNKS)
    none = sc.Scope("a", ())
    assert sc.scoped_chunks(df, none).count() == 0
    assert "LocalTableScan <empty>" in sc.scoped_chunks(df, none)._jdf.queryExecution().executedPlan().toString() or sc.scoped_chunks(df, none).isEmpty()


def test_fail_closed_conversions(spark):
    df = spark.createDataFrame([(0, "mirrored"), (3, "odd"), (9, None), (None, "derived")], "c int, l string")
    got = df.select(confidentiality(F.col("c")).alias("c"), acl_label(F.col("l")).alias("l")).collect()
    assert [tuple(x) for x in got] == [(0, "mirrored"), (3, "admin-assigned"), (3, "admin-assigned"), (3, "derived")]


def test_compile_scope(spark):
    tomb = spark.createDataFrame([(1, 50), (1, 200), (2, 10), (3, 100)], "token long, at long")
    gone = spark.createDataFrame([(5,)], "token long")
    s = sc.compile_scope(sc.Scope("a", (1, 2, 3, 4, 5), 3, (), 100), tomb, gone, sc.Purpose(1))
    assert (s.principals, s.ceiling) == ((1, 2, 4), 1)  # the first tombstone counts: 1 at 50 is before the issue
    assert sc.compile_scope(sc.Scope("a", (1,), 3), tomb, gone, has_engine=False).ceiling == 2
    assert sc.compile_scope(sc.Scope("a", (4,), 3), tomb, gone, lag=90).principals == ()
    assert sc.compile_scope(sc.Scope("a", (4,), 3), tomb, gone, sc.Purpose(3, True)).principals == ()
    with pytest.raises(PermissionError):
        sc.write_entities(("crm:b",), sc.Scope("a", (1,), 3, ("crm:a",)))


def play(events):
    """The state machine, event by event."""
    now, past = None, []
    for arrival, valid_from, value in events:
        if now is None:
            now = [arrival, valid_from, value, None]
        elif value == now[2]:
            continue
        elif valid_from <= now[1]:
            past.append((arrival, valid_from, value, now[1]))
        else:
            past.append((now[0], now[1], now[2], valid_from))
            now = [arrival, valid_from, value, None]
    return sorted([*past, tuple(now)], key=str) if now else []


def test_fact_state_machine(spark):
    r = random.Random(4)
    keys = {"late": [(1, 1, "A"), (2, 5, "A"), (3, 3, "B")], "null": [(1, 1, None), (2, 2, None), (3, 3, "x")], "back": [(1, 9, "A"), (2, 3, "B"), (3, 9, "C"), (4, 12, "B")]}
    keys |= {f"k{i}": [(j, r.randint(0, 20), r.choice(["a", "b", "c"])) for j in range(r.randint(1, 15))] for i in range(40)}
    events = [("t", "s", k, "f", v, x, a) for k, es in keys.items() for a, x, v in es]
    r.shuffle(events)
    df = spark.createDataFrame(events, "tenant string, source string, entity_id string, field string, value string, valid_from long, arrival long").repartition(5)
    got = {}
    for x in facts.versions(df).collect():
        got.setdefault(x["entity_id"], []).append((x["arrival"], x["valid_from"], x["value"], x["valid_to"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: play(es) for k, es in keys.items()}
    late = facts.versions(df).where("entity_id = 'late' AND valid_to IS NULL").head()
    assert late["value"] == "B"  # equal values do not move the time that lateness is judged by


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    from quarry.streaming import facts as stream
    from quarry.streaming import subscribe as sub

    r = random.Random(6)
    events = [("t", "s", f"k{r.randint(0, 5)}", "f", r.choice("abc"), r.randint(0, 30), a) for a in range(120)]
    schema = "tenant string, source string, entity_id string, field string, value string, valid_from long, arrival long"
    where = str(tmp_path / "in")
    for k in range(3):  # each run resumes from the checkpoint
        spark.createDataFrame(events[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(where)
        log = stream.fact_log(spark.readStream.schema(schema).parquet(where))
        sub.run_once(log, "t", str(tmp_path / "state"), str(tmp_path / "out"))
    cols = ["entity_id", "arrival", "valid_from", "value", "valid_to", "superseded_by", "outcome"]
    got = stream.versions_of(spark.read.schema(stream.LOG).parquet(str(tmp_path / "out"))).select(*cols)
    want = facts.versions(spark.createDataFrame(events, schema)).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_closure_and_components_with_cycles(spark):
    edges = spark.createDataFrame([("u", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "y")], "member string, parent string")
    pairs = {(x["member"], x["ancestor"]) for x in graph.closure(edges).collect()}
    ring = {(p, q) for p in "abc" for q in "abc"}
    assert pairs == ring | {("u", q) for q in "abc"} | {("x", "y")}
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {x["node"]: x["root"] for x in graph.components(links).collect()}
    assert all(roots[i] == 0 for i in range(31)) and roots[101] == 100


def test_fold_guards(spark):
    cols = "id string, left_ref string, right_ref string, tier int, method string, key_kind string, key_value string, namespace string, polarity int"
    e = lambda i, a, b, tier=1, method="crm_fk", key=None, p=1: (i, a, b, tier, method, method, key, "n", p)
    rows = [e("1", "s:a", "s:b"), e("2", "s:b", "s:c"), e("3", "s:d", "s:e"), e("4", "s:d", "s:e", 2, "human_rejected", p=-1), e("5", "s:f", "s:g", 2, "name"), e("6", "s:h", "s:i", 2, "name"), e("7", "s:h", "s:i", 2, "human_confirmed")]
    rows += [e(f"k{x}", f"s:{x}", "key:domain:z", 1, "domain", "z") for x in "pqr"] + [e(f"l{x}", f"s:{x}", "key:external_id:1", 1, "external_id", "1") for x in "tuv"]
    rows += [e("8", "s:j", "s:k", 1, "email_exact", "m")]
    df = spark.createDataFrame(rows, cols)
    aliases, reviews = resolve.fold(df, resolve.Config(min_independent_keys=2, size_cap=10))
    got = {x["ref"]: (x["canonical"], x["confidence"]) for x in aliases.collect()}
    assert got == {"s:a": ("canon:s:a", "deterministic"), "s:b": ("canon:s:a", "deterministic"), "s:c": ("canon:s:a", "deterministic"), "s:h": ("canon:s:h", "human_confirmed"), "s:i": ("canon:s:h", "human_confirmed"), **{f"s:{x}": ("canon:s:t", "deterministic") for x in "tuv"}}
    assert sorted((x["reason"], x["subject"]) for x in reviews.collect()) == [("anti_link_split", "s:d"), ("key_fan_out", "key:domain:z")]
    capped = resolve.fold(df, resolve.Config(size_cap=2))[1].where("reason = 'size_cap_exceeded'").collect()
    assert {x["subject"] for x in capped} == {"s:a", "s:t"}


def test_blocking_loses_no_pair(spark):
    r = random.Random(8)
    words = ["acme", "data", "works", "north", "wind", "tools", "labs"]
    rows = [(f"r{i}", " ".join(r.sample(words, r.randint(1, 3))), r.choice([None, "a.com", "b.com"])) for i in range(60)]
    got = {(x["left_ref"], x["right_ref"]): x["score"] for x in resolve.block_pairs(spark.createDataFrame(rows, "ref string, name string, domain string"), 0.45).collect()}
    gram = lambda n: {f"  {n} "[i : i + 3] for i in range(len(n) + 1)}
    jac = lambda a, b: len(a & b) / len(a | b)
    want = {}
    for i, (a, n, d) in enumerate(rows):
        for b, m, e in rows[i + 1 :]:
            score = max(jac(set(n.split()), set(m.split())), jac(gram(n), gram(m)))
            score = max(score, 0.9) if d and d == e else score
            if score >= 0.45:
                want[min(a, b), max(a, b)] = round(score, 4)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.01e-4 for k in want)


def test_lexicon_by_runs_equals_broadcast(spark):
    s = spark.createDataFrame([(1, "Call Acme Corp now"), (2, "nothing"), (3, None), (4, "acm"), (5, "the ACME corporation")], "id long, statement string")
    terms = spark.createDataFrame([("acme",), ("corp",), ("abc",), ("acme corp",)], "term string")
    a = sorted(map(tuple, knowledge.identifying(s, terms).collect()))
    b = sorted(map(tuple, knowledge.identifying(s, terms, sent=0).collect()))
    assert a == b == [(1, "acme"), (5, "acme")]


def test_splitter_counts_bytes():
    assert documents.pieces("é" * 1500) == ["é" * 1000, "é" * 500]
    for text in ("", "\n\n\n", "x" * 5000, "p\n\n" * 900, "é漢" * 900 + "\n\nend"):
        out = documents.pieces(text)
        assert all(0 < len(p.encode()) <= 2000 for p in out)
        assert "".join("".join(out).split()) == "".join(text.split())


def test_envelopes(spark):
    rows = [
        (1, '{"payload":{"op":"u","source":{"connector":"pg","db":"d","schema":"s","table":"t","ts_ms":5000},"after":{"id":7,"name":"x"},"acl":{"visibility":[1,2]}}}'),
        (2, '{"op":"d","source":{"connector":"pg","db":"d","schema":"s","table":"t"},"ts_ms":6000,"before":{"id":7}}'),
        (3, '{"op":"c","source":{"connector":"pg","db":"d","schema":"s","table":"t","ts_ms":1},"after":{"id":8,"n":1},"acl":{"visibility":"everyone"}}'),
        (4, "not json"),
    ]
    ev = {x["arrival"]: x for x in cdc.parse_envelopes(spark.createDataFrame(rows, "arrival long, body string")).collect()}
    assert (ev[1]["op"], ev[1]["entity_id"], ev[1]["visibility"], ev[1]["confidentiality"], ev[1]["acl_label"]) == ("upsert", "7", [1, 2], 1, "mirrored")
    assert (ev[2]["op"], ev[2]["entity_id"], ev[2]["ts_ms"]) == ("delete", "7", 6000)
    assert ev[3]["visibility"] is None and ev[4]["op"] is None


def test_routes(spark):
    body = '{"type":"Issue","data":{"state":"open","tags":[{"n":"a"},{"n":"b"}]}}'
    df = spark.createDataFrame([(body,)], "body string")
    for text, want in (("type = Issue", True), ("type != Issue", False), ("gone != x", False), ("type in [Note, Issue] and data.state = open", True), ("data.state = shut", False)):
        assert df.select(manifest.route(text)).head()[0] is want
    assert df.select(manifest.paths("data.tags[].n"), manifest.paths("data.none[].n")).head()[:] == (["a", "b"], [])


def test_envelope_poisoning(spark):
    kind = "p array<struct<type:string,email:string,domain:string,role:string,deleted:boolean>>"
    rows = [([("user", "A@x.com", None, "r", None), ("anyone", None, None, "r", False)],), ([("user", "a@x.com", None, "r", None), ("alien", None, None, "r", None)],), ([("user", None, None, "r", None)],), ([("alien", None, None, "r", True), ("group", "g@x.com", None, "r", None)],), ([],), (None,)]
    got = [x[0] for x in spark.createDataFrame(rows, kind).select(connectors.drive_envelope(F.col("p"))).collect()]
    assert got == [["anyone", "user:a@x.com"], None, None, ["group:g@x.com"], None, None]


def test_intersections(spark):
    df = spark.createDataFrame([([[1, 2, 3], [2, 3], [3, 2, 9]],), ([],), ([[1], [2]],), ([[4, 1]],)], "v array<array<bigint>>")
    assert [x[0] for x in df.select(reads.intersection(F.col("v"))).collect()] == [[2, 3], [], [], [1, 4]]


def test_threads_and_channels(spark):
    m = spark.createDataFrame([("c", "1", None, "", "Ann", "u1", "hi"), ("c", "3", "1", "B", None, "u2", "yo"), ("c", "2", "1", None, None, "u3", None)], "channel string, ts string, thread_ts string, display_name string, real_name string, user string, text string")
    assert connectors.thread_documents(m).head()["content"] == "Ann: hi\nu3: \nB: yo"
    c = spark.createDataFrame([((True, False, False, False, False),), ((False, True, False, False, True),), ((False, False, False, True, False),), ((False, None, None, False, True),), ((False, False, False, False, False),)], "c struct<is_im:boolean,is_shared:boolean,is_ext_shared:boolean,is_private:boolean,is_channel:boolean>")
    assert [x[0] for x in c.select(connectors.channel_class(F.col("c"))).collect()] == ["skip", "quarantine", "members", "workspace", "quarantine"]


def test_documents_page_and_fsck_shapes(spark):
    df = spark.createDataFrame(rows_of(9), CHUNKS)
    page = access.documents_page(df, "a", 10)
    assert page.agg(F.sum("n_chunks")).head()[0] == 10
    assert access.unresolved_tokens(df, spark.createDataFrame([(i,) for i in range(6)], "token long")).count() == 0
