"""What is kept up to date, against plain versions: restarts, random changes, hot keys, files left alone."""

from __future__ import annotations

import math
import os
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.operators import asof, hierarchy, postings, refold, resolve, sketches
from quarry.operators import scope as sc
from quarry.sources import connector
from quarry.sources.files import Files
from quarry.streaming import membership, refresh
from quarry.streaming import subscribe as sub


def test_files_rewrite_only_what_holds_the_keys(spark, tmp_path):
    files = Files(spark, str(tmp_path / "t"), "k long, v string")
    assert files.read().count() == 0 and files.rewrite(spark.range(1).select(F.col("id").alias("k")), ["k"]) == []
    for at in range(4):
        files.add(spark.range(at * 100, at * 100 + 100).selectExpr("id AS k", "'secret' || id AS v").coalesce(1))
    before = files.names()
    touched = files.rewrite(spark.createDataFrame([(7,), (250,), (999,)], "k long"), ["k"])
    assert len(touched) == 2 and len(set(before) & set(files.names())) == 2
    assert sorted(r.k for r in files.read().collect()) == [k for k in range(400) if k not in (7, 250)]
    on_disk = [os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    assert all({"secret7", "secret250"}.isdisjoint(pq.read_table(f).column("v").to_pylist()) for f in on_disk)
    # what a run that stopped has left is never read, and goes
    spark.range(5).selectExpr("id AS k", "'lost' AS v").coalesce(1).write.parquet(str(tmp_path / "t" / ("d-" + "0" * 32)))
    assert files.read().where("v = 'lost'").isEmpty() and files.sweep() == 1 and files.read().count() == 398
    # two writers of one version: the second one fails and changes nothing
    files._list([], set())
    stale = Files(spark, str(tmp_path / "t"), "k long, v string")
    stale.version = lambda: files.version() - 1
    with pytest.raises(Exception):  # noqa: B017  whichever comes first: the list is gone, or the next one is there
        stale.add(spark.range(1).selectExpr("id AS k", "'x' AS v"))
    assert files.read().count() == 398


def _events(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("'fact' AS kind", "'s' AS source", "'e' || id AS entity_id", "'f' AS field", "'v' AS value", "id AS valid_from", "CAST(NULL AS STRING) AS content", "CAST(NULL AS STRING) AS mime_type", "CAST(NULL AS STRING) AS version", "IF(id % 3 = 0, NULL, id % 3 = 1) AS resolvable", "array('p') AS principals", "array() AS groups", "array() AS tags", "id div 10 AS page")


def test_connector_resumes_and_takes_each_page_once(spark, tmp_path):
    pages, state, out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")
    connector.write_pages(_events(spark, 0, 40), "page", pages)

    def fails(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        raise RuntimeError("halfway")

    def run(each):
        connector.pages(spark, pages, stream=True).writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="halfway"):
        run(fails)
    os.makedirs(f"{pages}/_writing")  # no page
    connector.write_pages(_events(spark, 40, 75), "page", pages)
    run(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    run(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    got = spark.read.parquet(out)
    assert sorted(r.valid_from for r in got.collect()) == list(range(75))
    assert connector.pages(spark, pages).count() == 75
    assert connector.pages(spark, pages, cursor="page=000000000006").count() == 5
    assert connector.pages(spark, pages, cursor="page=000000000007").count() == 0
    taken, held = connector.admitted(got)
    assert (taken.count(), held.count()) == (25, 50)


def _folder_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_tombstones_survive_a_restart(spark, tmp_path):
    rng = random.Random(3)
    edges = spark.createDataFrame([("g:a", "g:top"), ("g:b", "g:top"), ("g:c", "g:none")], "member string, parent string")
    tokens = spark.createDataFrame([("g:a", 1), ("g:b", 2), ("g:top", 9)], "principal string, token long")
    rows = [(s, f"u:{s % 4}" if s % 9 else None, rng.choice(["g:a", "g:b", "g:c", "g:top"]), s * rng.choice([1, 1, 2])) for s in range(200)]
    rows.sort(key=lambda r: r[3])
    schema = "seq long, member string, parent string, at long"
    want, last = set(), {}
    for seq, member, parent, at in sorted(rows, key=lambda r: (r[3], r[0])):
        for principal in {"g:a": ("g:a", "g:top"), "g:b": ("g:b", "g:top"), "g:c": (), "g:top": ("g:top",)}[parent]:
            token = {"g:a": 1, "g:b": 2, "g:top": 9}[principal]
            if token not in last or at - last[token] > 15:
                last[token] = at
                want.add((token, principal, seq, member or "watch:unresolved-member", at))
    got = None
    for part in (rows[:90], rows[90:150], rows[150:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = membership.tombstones(_folder_stream(spark, str(tmp_path / "in"), schema), edges, tokens)
        got = sub.run_once(stream, "t", str(tmp_path / "state"), str(tmp_path / "out"), idle=False)
    found = spark.read.schema(membership.TOMBSTONES).parquet(got)
    assert {tuple(r) for r in found.collect()} == want
    hidden = membership.hidden(spark.createDataFrame([(9, "g:top", 1, "g:x", 5)], membership.TOMBSTONES), spark.createDataFrame([("u:1", "g:x"), ("g:y", "g:x"), ("u:2", "g:y")], "member string, parent string"))
    assert {r.principal for r in hidden.collect()} == {"g:x", "u:1", "g:y", "u:2"}


def test_feed_latch_over_restarts(spark, tmp_path):
    schema = "feed string, seq long, resync boolean"
    parts = [[("f", s, False) for s in (1, 2, 3)], [("f", s, False) for s in (3, 6, 7)], [("f", 8, True), ("f", 9, False), ("g", 5, False)], [("f", 12, False), ("g", 6, False)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = sub.run_once(membership.feed_events(_folder_stream(spark, str(tmp_path / "in"), schema)), "f", str(tmp_path / "state"), str(tmp_path / "out"))
    events = spark.read.schema(membership.FEED).parquet(out)
    assert sorted(tuple(r) for r in events.collect()) == [("f", "gap", 4, 6), ("f", "gap", 10, 12), ("f", "resync", 6, 8)]
    assert sorted(tuple(r) for r in membership.degraded(events).collect()) == [("f", 6, 8), ("f", 12, None)]


def test_subscription_scope_per_batch_and_fence(spark, tmp_path):
    schema = "tenant string, action_id long, occurred_at long, visibility array<long>, confidentiality int"
    scopes = [sc.Scope("a", (1, 2)), sc.Scope("a", (1,)), sc.Scope("a", (1,))]
    stale, turn = [False, False, True], 0
    seen: dict[int, list[int]] = {}

    def deliver(rows, number):
        seen[number] = sorted(r.action_id for r in rows.collect())

    for turn in range(3):
        rows = [("a", turn * 10 + i, 100, [1 + i % 2], 1) for i in range(4)] + [("b", 900 + turn, 100, [1, 2], 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = sub.subscribe(_folder_stream(spark, str(tmp_path / "in"), schema), lambda: scopes[turn], deliver, str(tmp_path / "state"), lambda: stale[turn])
        if stale[turn]:
            with pytest.raises(Exception, match="StaleFence"):
                query.awaitTermination()
        else:
            query.awaitTermination()
    assert seen == {0: [0, 1, 2, 3], 1: [10, 12]}
    sub.subscribe(_folder_stream(spark, str(tmp_path / "in"), schema), lambda: scopes[2], deliver, str(tmp_path / "state")).awaitTermination()
    assert seen[2] == [20, 22]  # what the fence held back comes when it is fresh
    rows = spark.read.parquet(str(tmp_path / "in"))
    page, mark = sub.poll(rows, scopes[0], sub.START, most=5)
    again, end = sub.poll(rows, scopes[1], mark, most=5)
    assert [r.action_id for r in page.orderBy("action_id").collect()] == [0, 1, 2, 3, 10] and mark == (100, 10)
    assert [r.action_id for r in again.orderBy("action_id").collect()] == [12, 20, 22]
    assert sub.poll(rows, scopes[1], end)[1] == end
    with pytest.raises(sub.StaleFence):
        sub.poll(rows, scopes[0], mark, fence=True)


def test_debounce_over_restarts(spark, tmp_path):
    schema = "subject string, at timestamp"
    times = {"a": [0, 50, 90, 400, 1000], "b": [100, 900, 950], "c": [20_000]}
    rows = sorted((t, s) for s, ts in times.items() for t in ts)
    for part in (rows[:4], rows[4:7], rows[7:]):
        spark.createDataFrame(part, "t long, subject string").selectExpr("subject", "timestamp_seconds(t + 100000) AS at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = sub.run_once(refresh.due(_folder_stream(spark, str(tmp_path / "in"), schema), 100, "10 minutes"), "d", str(tmp_path / "state"), str(tmp_path / "out"))
    got = sorted((r.subject, r.due - 100_000, r.touches) for r in spark.read.schema(refresh.DUE).parquet(out).collect())
    assert got == [("a", 190, 3), ("a", 500, 1), ("a", 1100, 1), ("b", 200, 1), ("b", 1050, 2)]


CHUNKS = "tenant string, id long, content string, visibility array<long>, confidentiality int, valid_to long, tags array<string>, kind string"


def _best(rows, terms, k, seen):
    """BM25 by the formula over (tenant a, id, content)."""
    words = {i: re.findall("[a-z0-9]+", (c or "").lower()) for t, i, c, *_ in rows if t == "a"}
    n, mean = len(words), sum(map(len, words.values())) / max(len(words), 1)
    df = {t: sum(t in w for w in words.values()) for t in terms}
    out = []
    for i, w in words.items():
        if any(t in w for t in terms) and i in seen:
            out.append((-round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if t in w), 6), i))
    return [i for _, i in sorted(out)[:k]]


def test_postings_follow_changes_and_forget(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(400)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))
    row = lambda i: (rng.choice("aaab"), i, text() if i % 13 else None, [1 + i % 2], 1, None, ["t"], "document")
    rows = {i: row(i) for i in range(0, 3000, 2)}
    df = lambda rs: spark.createDataFrame(list(rs), CHUNKS)
    index = postings.build_index(df(rows.values()), str(tmp_path / "i"))
    scope = sc.Scope("a", (1,))

    def check():
        now = df(rows.values())
        seen = {i for i, r in rows.items() if r[0] == "a" and 1 in r[3]}
        for query in ("w1 w2", "w7 w13 w59", "w3", "nothing"):
            got = [r.id for r in postings.bm25(index, now, scope, query, 7, ahead=1).collect()]
            assert got == _best(rows.values(), query.split(), 7, seen), query

    check()
    changed = [i for i in rows if i % 3 == 0]
    before = [rows[i] for i in changed]
    for i in changed:
        if i % 4 == 0:
            del rows[i]
        else:
            rows[i] = (rows[i][0], i, text() + " w7", *rows[i][3:])
    new = [row(i) for i in range(1, 400, 2)]
    rows |= {r[1]: r for r in new}
    postings.update(index, df(before), df([rows[i] for i in changed if i in rows] + new))
    check()
    gone = [r for r in rows.values() if r[1] % 7 == 3]
    marked = [(r[0], r[1], f"{r[2] or ''} erasedword{r[1]}", *r[3:]) for r in gone]
    postings.update(index, df(gone), df(marked))
    postings.erase(index, df(marked))
    for r in gone:
        del rows[r[1]]
    check()
    postings.compact(index)
    check()
    ids = {r[1] for r in gone}
    for d, _, names in os.walk(tmp_path):
        for f in names:
            if f.endswith(".parquet") and "/postings/" in d:
                table = pq.read_table(os.path.join(d, f)).to_pydict()
                assert not any("erasedword" in t for t in table["term"])
                assert all(ids.isdisjoint(i) for i in table["ids"])


def test_postings_skip_spans(spark, tmp_path):
    """Spans whose bound is under the kth score are not read: one strong span among many weak ones."""
    rows = [("a", i, "rare " * 5 if i < 20 else "rare " + "filler " * 30, [1], 1, None, ["t"], "document") for i in range(0, 40 * postings.SPAN, 4)]
    index = postings.build_index(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "i"))
    got = postings.bm25(index, spark.createDataFrame(rows, CHUNKS), sc.Scope("a", (1,)), "rare", 3, ahead=1)
    assert [r.id for r in got.collect()] == [0, 4, 8]
    stats = index.numbers().where("tenant = 'a'").head()
    assert stats["n"] == len(rows)


def test_refold_equals_the_whole_fold_and_reads_what_it_touches(spark, tmp_path):
    rng = random.Random(4)
    config = resolve.Config(size_cap=7)
    rows = []
    for i in range(260):
        a, b = rng.sample(range(150), 2)
        kind = rng.random()
        if kind < 0.35:
            rows.append((f"e{i}", f"r:{a}", f"key:domain:d{rng.randint(0, 40)}", 1, "domain", "domain", "d", "n", 1))
        elif kind < 0.45:
            rows.append((f"e{i}", f"r:{a}", f"key:external_id:x{rng.randint(0, 30)}", 1, "external_id", "external_id", "x", "n", 1))
        elif kind < 0.8:
            rows.append((f"e{i}", f"r:{a}", f"r:{a // 4 * 4}", 1, "crm_fk", "crm_fk", str(i), "n", 1))
        else:
            rows.append((f"e{i}", f"r:{a}", f"r:{b}", 2, *rng.choice([("human_rejected", "human", None, "n", -1), ("human_confirmed", "human", "h", "n", 1), ("name_match", "name", None, "n", 1)])))
    rows = [r for r in rows if r[1] != r[2]]
    df = lambda rs: spark.createDataFrame(rs, refold.EVIDENCE)
    store = refold.Resolution(spark, str(tmp_path / "fold"), config, parts=16)
    for at in (0, 120, 200):
        store.add(df(rows[at : at + (120 if at == 0 else 80)]))
    aliases, reviews = resolve.fold(df(rows[:280]), config)
    plain = lambda d: sorted(tuple(map(str, r)) for r in d.select(*sorted(d.columns)).collect())
    assert plain(store.aliases()) == plain(aliases) and plain(store.reviews()) == plain(reviews)
    # a batch on two new refs: the files of all parts but theirs may as well not be there
    before = {n: os.path.join(tmp_path, "fold", n) for n in store.files.names()}
    new = [("n1", "z:1", "z:2", 1, "crm_fk", "crm_fk", "z", "n", 1)]
    parts = {r[0] for r in spark.createDataFrame([("z:1",), ("z:2",)], "k string").select(store._part(F.col("k"))).collect()}
    away = [n for n in before if int(re.search(r"part=(\d+)", n)[1]) not in parts]
    for n in away:
        os.rename(before[n], before[n] + ".away")
    store.add(df(new))
    for n in away:
        os.rename(before[n] + ".away", before[n])
    assert set(away) <= set(store.files.names())
    aliases, _ = resolve.fold(df(rows + new), config)
    assert plain(store.aliases()) == plain(aliases)
    # the same batch again changes nothing
    store.add(df(new))
    assert plain(store.aliases()) == plain(aliases)


@pytest.mark.parametrize("slices", [1, 9])
def test_asof_equals_brute_force(spark, slices):
    rng = random.Random(slices)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    versions = [(key(), rng.choice([None, *range(0, 200, 3)]), f"v{i}", i) for i in range(120)]
    probes = [(i, key(), rng.choice([None, *range(-10, 220)])) for i in range(400)]
    got = asof.asof_join(spark.createDataFrame(probes, "id long, k string, t long"), spark.createDataFrame(versions, "k string, b long, v string, n long").repartition(3), ["k"], "t", "b", ["v", "b"], "n", slices)
    want = {}
    for i, k, t in probes:
        held = [(b, n, v) for vk, b, v, n in versions if vk is not None and vk == k and b is not None and t is not None and b <= t]
        want[i] = max(held)[2] if held else None
    assert {r.id: r.v for r in got.collect()} == want
    assert got.count() == 400


def test_role_ancestors_end(spark):
    roles = [(str(i), str(i // 2)) for i in range(2, 40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), (None, "1"), ("n", None)]
    got = {(r.role, r.ancestor): r.level for r in hierarchy.role_ancestors(spark.createDataFrame(roles, "role string, parent string")).collect()}
    want = {}
    for i in range(2, 40):
        at, level = i // 2, 1
        while at >= 1:
            want[str(i), str(at)] = level
            at, level = at // 2, level + 1
    want |= {("x", "y"): 1, ("x", "z"): 2, ("y", "z"): 1, ("y", "x"): 2, ("z", "x"): 1, ("z", "y"): 2}
    assert got == want
    assert hierarchy.role_ancestors(spark.createDataFrame([], "role string, parent string")).count() == 0


def test_sketches_keep_their_rank_error(spark):
    samples = spark.range(200_000).selectExpr("IF(id % 4 = 0, 'b', 'a') AS `group`", "id % 400 * 900 AS at", "exp(randn(7)) * 10 AS value")
    hours = sketches.hourly(samples)
    for start, end in ((0, 100), (10, 11), (20, 60)):
        exact = samples.where(f"at div 3600 >= {start} AND at div 3600 < {end}").groupBy("group").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()
        found = {r["group"]: r for r in sketches.over(hours, start, end).collect()}
        for r in exact:
            for p in sketches.PERCENTS:
                rank = sum(x <= found[r["group"]][f"p{p}"] for x in r["v"]) / len(r["v"])
                assert abs(rank - p / 100) <= sketches.RANK_ERROR
            assert found[r["group"]]["n"] == len(r["v"])
    assert sketches.over(hours, 5000, 6000).count() == 0
    burn = {r["group"]: r for r in sketches.burn(hours, 10.0, 0.9, 0, 100).collect()}
    assert abs(burn["a"]["within"] - 0.5) < 0.02 and abs(burn["a"]["burn"] - 5) < 0.2


def test_lists_recall(spark, tmp_path):
    """Recall at ten of 0.9 or more from a quarter of the lists, over queries of their own; a narrow scope is scanned."""
    import numpy as np

    from quarry.operators import retrieval, vector_index

    rng = np.random.default_rng(2)
    centers = rng.normal(size=(60, 24))
    x = centers[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 24)) * 0.6
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(6000, [0.0] * 24), (6001, None)], "id long, embedding array<double>")
    chunks = spark.createDataFrame([("a", i, "x", [1 + (i % 200 == 0)], 1, None, ["t"], "document") for i in range(6002)], CHUNKS)
    index = vector_index.build(chunks, vectors, str(tmp_path / "v"), sample=2000)
    assert index.vectors.read().count() == 6000
    wide, narrow = sc.Scope("a", (1, 2)), sc.Scope("a", (2,))
    assert vector_index.sees_at_most(index, narrow) == 31 and vector_index.sees_at_most(index, sc.Scope("a", ())) == 0
    hits = 0
    queries = (centers[:8] + rng.normal(size=(8, 24)) * 0.6).tolist()
    for q in queries:
        near = {r.id for r in vector_index.recall_routed(index, chunks, vectors, wide, q, 10, bound=100).collect()}
        hits += len(near & {r.id for r in retrieval.dense(chunks, vectors, wide, q, 10).collect()})
    assert hits >= 0.9 * 10 * len(queries)
    q = queries[0]
    exact = [r.id for r in retrieval.dense(chunks, vectors, narrow, q, 10).collect()]
    assert [r.id for r in vector_index.recall_routed(index, chunks, vectors, narrow, q, 10, bound=100).collect()] == exact
    # lists are read until there are ten, so a narrow scope finds as many through the index
    assert len(vector_index.recall_routed(index, chunks, vectors, narrow, q, 10, bound=0, probed=0.01).collect()) == 10


def test_forms_by_automaton_and_by_join(spark):
    from quarry.operators import gazetteer

    rng = random.Random(6)
    forms = ["a b", "b", "b c a", "Ünïted  A-b", "a a", "", "--", "c c c c c c c"]
    texts = [(i, " ".join(rng.choice(["a", "B", "c", "ünïted", "a-b", "ab", "."]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "c " * 9)]
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = sorted((i, " ".join(f), p) for i, t in texts for f in {tuple(norm(f)) for f in forms} - {()} for p in range(len(norm(t))) if tuple(norm(t)[p : p + len(f)]) == f)
    df, own = spark.createDataFrame(texts, "id long, content string"), spark.createDataFrame([(f,) for f in forms], "form string")
    for sent in (100, 0):
        assert sorted((r.id, r.form, r.at) for r in gazetteer.found_forms(df, own, sent).collect()) == want
    assert gazetteer.found_forms(df, own.limit(0)).count() == 0


def test_near_forms_lose_nothing(spark):
    from quarry.operators import gazetteer

    rng = random.Random(9)
    make = lambda n: [" ".join(rng.sample("abcdefgh", rng.randint(0, 6))) for _ in range(n)]
    mentions, forms = make(80), make(80)
    want = {(m, f) for m in mentions for f in forms if m and f and len(set(m.split()) & set(f.split())) / len(set(m.split()) | set(f.split())) >= 0.6}
    got = gazetteer.near_forms(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame([(f,) for f in forms], "form string")).collect()
    assert {(r.mention, r.form) for r in got} == want and len(got) == len(want)
