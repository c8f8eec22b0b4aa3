"""What held on small tables alone: each test is a small table that has what a large one has."""

from __future__ import annotations

import math
import random
import re
from types import SimpleNamespace

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.operators import facts, graph, hierarchy, knowledge, postings, resolve, retrieval
from quarry.operators import scope as sc
from quarry.plans import registry
from quarry.plans.compare import differences
from quarry.streaming import membership, refresh


@pytest.fixture
def conf(spark):
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_ancestors_beyond_what_a_recursion_may_hold(spark, conf):
    """900,000 roles have over the million rows that one recursive query may give."""
    conf("spark.sql.cteRecursionRowLimit", "1000")
    n = 3000
    roles = spark.range(n).select(F.col("id").cast("string").alias("role"), F.when(F.col("id") > 0, ((F.col("id") - 1) / 3).cast("long").cast("string")).alias("parent"))
    up = {i: (i - 1) // 3 for i in range(1, n)}
    want = set()
    for i in range(n):
        at, level = i, 0
        while at in up:
            at, level = up[at], level + 1
            want.add((str(i), str(at), level))
    assert {tuple(r) for r in hierarchy.role_ancestors(roles).collect()} == want


def test_ancestors_of_long_chains_and_cycles(spark):
    """A chain longer than is followed, a cycle of seven with a tail, a role above itself, and two parents."""
    rows = [(f"c{i}", f"c{i + 1}") for i in range(100)] + [(f"y{i}", f"y{(i + 1) % 7}") for i in range(7)] + [(f"t{i}", f"t{i + 1}" if i < 11 else "y3") for i in range(12)] + [("s", "s"), ("two", "y5"), ("two", "c98"), ("none", None)]
    roles = spark.createDataFrame(rows, "role string, parent string")
    up = {}
    for role, parent in rows:
        if parent is not None and parent != role:
            up[role] = min(parent, up.get(role, parent))
    want = set()
    for role in up:
        passed, at = [role], role
        while at in up and up[at] not in passed and len(passed) <= 64:
            at = up[at]
            want.add((role, at, len(passed)))
            passed.append(at)
    got = [tuple(r) for r in hierarchy.role_ancestors(roles).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in hierarchy.role_ancestors(roles, 5).collect()} == {w for w in want if w[2] <= 5}


def test_fidelity_audits_given_pairs_alone(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1), (None, 1)], "user string, record long")
    granted = spark.createDataFrame([("a", 1), ("a", 1), ("x", 9), (None, 1)], "user string, record long")
    truth = spark.createDataFrame([("a", 1), ("b", 1), ("y", 9)], "user string, record long")
    users = spark.createDataFrame([("a", True, False), ("b", True, True)], "user string, federated boolean, view_all boolean")
    got = {tuple(r) for r in graph.fidelity(pairs, granted, truth, users).collect()}
    assert got == {("a", 1, "match_grant", "none"), ("b", 1, "over_hide", "view_all"), ("c", 1, "match_deny", "none"), (None, 1, "match_deny", "none")}


def test_tier2_without_pairs_that_say_nothing(spark):
    """As of all blocked pairs, names or domains that are null, empty, repeated or not alike among them."""
    words = ["red", "bolt", "ring", "steel", "co"]
    rows = [(f"r{i:02d}", [None, "", " ".join(w for k, w in enumerate(words) if i >> k & 1), words[i % 5]][i % 4], [None, "a.com", "b.com"][i % 3]) for i in range(48)]
    e = spark.createDataFrame(rows, "ref string, name string, domain string")
    want = resolve.tier2_evidence(resolve.block_pairs(e), e, "n", 7)
    got = resolve.tier2_of_domains(e, "n", 7)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert want.count() < resolve.block_pairs(e).count()


def test_pairs_of_one_name_are_dealt_out(spark):
    """Two names that are alike: neither their pairs nor those of one of them are made in one task."""
    e = spark.range(3_000).selectExpr("'r' || id AS ref", "CASE WHEN id % 20 = 0 THEN 'red bolts' ELSE 'red bolt' END AS name", "CAST(NULL AS STRING) AS domain")
    got = resolve.block_pairs(e).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 3_000 * 2_999 // 2
    assert max(r.n for r in got) < 3_000 * 2_999 // 4


def test_pairs_of_blocks_are_all_pairs(spark):
    """Classes of several blocks, names or domains that are null or empty, refs that come twice."""
    names, domains = ["red bolt", "red bolts", "", None, " ", "blue ring"], [None, "a.com", None, "b.com", ""]
    rows = [(f"r{i:02d}", names[i * 5 % 7 % 6], domains[i * 3 % 11 % 5]) for i in range(70)]
    rows += [("r03", "red bolt", None), ("r04", "red bolts", "a.com")]
    words = lambda s: {w for w in s.split(" ") if w}
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)} if s else set()
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    want = []
    for k, (r, n, d) in enumerate(rows):
        for q, m, o in rows[:k]:
            score = max(0 if n is None or m is None else max(jaccard(words(n), words(m)), jaccard(grams(n), grams(m))), 0.9 if d is not None and d == o else 0)
            if q != r and score >= 0.45:
                want.append((min(q, r), max(q, r), round(score, 4)))
    e = spark.createDataFrame(rows, "ref string, name string, domain string")
    for block in (1, 3, 256):
        assert sorted(map(tuple, resolve.block_pairs(e, block=block).collect())) == sorted(want)


@pytest.mark.parametrize("least", [True, False])
def test_briefs_whatever_the_numbers_of_partitions(spark, sf, conf, least):
    conf("spark.sql.adaptive.coalescePartitions.enabled", str(least).lower())
    conf("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.shuffle.partitions", "16")
    assert differences(spark, registry.QUERIES["brief_refresh"], registry.ORACLE_SQL["brief_refresh"], sf) == ""


def test_folder_lines_in_order_whatever_the_order_of_rows(spark, sf, tmp_path):
    """Labels in files that are not in order of their numbers."""
    spark.read.parquet(f"{sf}/labels.parquet").orderBy(F.desc("doc_id")).coalesce(1).write.parquet(str(tmp_path / "made"))
    file = next((tmp_path / "made").glob("*.parquet"))
    (tmp_path / "sf").mkdir()
    file.rename(tmp_path / "sf" / "labels.parquet")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "conversations"):
        (tmp_path / "sf" / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    assert differences(spark, registry.QUERIES["folder_versions"], registry.ORACLE_SQL["folder_versions"], str(tmp_path / "sf")) == ""


class _Handle:
    """State of one key, held in memory."""

    def __init__(self):
        self.value, self.list, self.timers = None, None, set()

    def getValueState(self, *_):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def getListState(self, *_):
        return SimpleNamespace(exists=lambda: self.list is not None, get=lambda: iter(self.list), put=lambda v: setattr(self, "list", list(v)), clear=lambda: setattr(self, "list", None))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_burst_is_due_by_the_watermark_alone():
    """A burst that a later touch follows is not due before the watermark says so, and a late touch may still join two."""
    d, handle = refresh.Debounce(100), _Handle()
    d.init(handle)
    frame = lambda *at: pd.DataFrame({"at": [pd.Timestamp(t, unit="s", tz="UTC") for t in at]})
    rows = lambda out: [tuple(r) for f in out for r in f.itertuples(index=False)]
    assert rows(d.handleInputRows(("u",), iter([frame(1000, 1300), frame(1010, 2000)]), None)) == []
    assert handle.timers == {1_110_000}
    assert rows(d.handleInputRows(("u",), iter([frame(1400, 1120, 1210)]), None)) == []
    assert handle.timers == {1_110_000}
    at = lambda s: SimpleNamespace(getCurrentWatermarkInMs=lambda: s * 1000)
    handle.timers.clear()
    assert rows(d.handleExpiredTimer(("u",), at(1110), None)) == [("u", 1110, 2)]
    assert rows(d.handleExpiredTimer(("u",), at(1999), None)) == [("u", 1500, 4)]
    assert rows(d.handleExpiredTimer(("u",), at(2100), None)) == [("u", 2100, 1)] and handle.list is None


def test_tombstones_hold_no_more_than_the_different_times(monkeypatch):
    held = []
    made = membership._first_by_time
    monkeypatch.setattr(membership, "HELD", 1000)
    monkeypatch.setattr(membership, "_first_by_time", lambda parts: held.append(sum(p.num_rows for p in parts)) or made(parts))
    t, handle = membership.Tombstones(15, 1), _Handle()
    t.init(handle)
    n = 50_000
    frames = (pd.DataFrame({"token": 1, "principal": "g", "seq": range(k, n, n // 500), "member": [f"u{s}" for s in range(k, n, n // 500)], "at": [s * 7919 % 300 for s in range(k, n, n // 500)]}) for k in range(n // 500))
    got = [(r.seq, r.member, r.at) for f in t.handleInputRows((1,), frames, None) for r in f.itertuples(index=False)]
    first = {}
    for s in range(n):
        first.setdefault(s * 7919 % 300, s)
    assert got == [(first[a], f"u{first[a]}", a) for a in range(0, 300, 16)]
    assert max(held) <= 3000 and handle.value == (got[-1][2],)
    assert [f for f in t.handleInputRows((1,), iter([pd.DataFrame({"token": [1], "principal": ["g"], "seq": [1], "member": ["x"], "at": [303]})]), None)] == []


def test_long_history_of_one_key(spark, conf):
    """A key's versions take time by their number (as arrays that grew, the square of it), and go on from batch to batch."""
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    n = 30_000
    events = spark.range(n).selectExpr("'a' AS tenant", "'s' AS source", "IF(id < 5, NULL, 'one') AS entity_id", "'f' AS field", "id AS arrival", "IF(id % 10 = 9, id - 20, id) AS valid_from", "IF(id % 4 = 3, NULL, CAST(id % 4 AS STRING)) AS value", "id % 100 = 50 AS gone")
    got = sorted(tuple(r) for r in facts.versions(events).select("arrival", "valid_from", "value", "valid_to", "superseded_by", "outcome", "entity_id").collect())
    want, now, before = [], None, None
    for i in range(n):
        entity, start, value = None if i < 5 else "one", i - 20 if i % 10 == 9 else i, None if i % 4 == 3 else str(i % 4)
        if entity != before and now is not None:
            want.append((*now[:3], None, None, now[3], before))
            now = None
        before = entity
        if i % 100 == 50:
            want.append((*now[:3], start, None, now[3], entity))
            now = None
        elif now is None:
            now = (i, start, value, "inserted")
        elif start <= now[1]:
            want.append((i, start, value, now[1], now[0], "stale", entity))
        else:
            want.append((*now[:3], start, i, now[3], entity))
            now = (i, start, value, "superseded")
    want.append((*now[:3], None, None, now[3], "one"))
    key = lambda r: tuple((x is not None, x) if x is not None else (False, "") for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_lexicon_in_blocks_tries_what_is_left(spark, monkeypatch):
    """A lexicon over what is sent comes in blocks by order; a statement that named a term is not tried again."""
    s = spark.createDataFrame([(1, "zebra and aardvark"), (2, "zebra"), (3, "none"), (4, "monkeys"), (5, None)], "id long, statement string")
    terms = spark.createDataFrame([(w,) for w in ("aardvark", "badger", "monkey", "monkeys", "zebra", "zoo")], "term string")
    sizes, made = [], knowledge.kept
    monkeypatch.setattr(knowledge, "kept", lambda df: sizes.append(made(df).where("term IS NULL").count()) or made(df))
    assert sorted(map(tuple, knowledge.identifying(s, terms, sent=2).collect())) == [(1, "aardvark"), (2, "zebra"), (4, "monkey")]
    assert sizes == [0, 3, 2, 1]  # the terms, then what is left behind each block


CHUNKS = "tenant string, id long, content string, visibility array<long>, confidentiality int, valid_to long, tags array<string>, kind string"


def _chunks(spark, rows):
    """Chunks of (id, content) that the tenant's first principal sees."""
    return spark.createDataFrame([("a", i, c, [1], 1, None, ["t"], "document") for i, c in rows], CHUNKS)


def _texts(n, words=120, start=0):
    rng = random.Random(n + start)
    return [(start + i * 2, " ".join(f"{rng.choice(['pre', 'con', 'dis'])}{int(rng.paretovariate(0.7)) % 3000}" for _ in range(words))) for i in range(n)]


def _shuffled(spark, act) -> int:
    """Bytes of the shuffle files that an action leaves."""
    held = lambda: (lambda files: {files.apply(i).getName(): files.apply(i).length() for i in range(files.size())})(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
    before = held()
    act()
    return sum(size for name, size in held().items() if name not in before and name.startswith("shuffle_"))


def _plain_scores(rows, query):
    """BM25 of (id, content) for a query's words, by the formula."""
    words = {i: re.findall("[a-z0-9]+", c.lower()) for i, c in rows}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    terms = set(re.findall("[a-z0-9]+", query.lower()))
    df = {t: sum(t in set(w) for w in words.values()) for t in terms}
    share = lambda t, w: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return {i: round(sum(share(t, w) for t in terms if t in w), 6) for i, w in words.items() if any(t in w for t in terms)}


def test_many_queries_shuffle_postings_and_not_their_pairs(spark, tmp_path, monkeypatch):
    """Queries that have words of every chunk: what is shuffled doesn't grow with how many they are; changed and negative ids among the chunks."""
    monkeypatch.setattr(postings, "QUERY_BLOCK", 7, raising=False)
    monkeypatch.setattr(postings, "PASS_BLOCKS", 3, raising=False)
    rows = _texts(700, start=-500)
    index = postings.build_index(_chunks(spark, rows), str(tmp_path / "i"))
    now = [(i, f"{c} pre1 pre1" if i % 3 == 0 else c) for i, c in rows if i % 10 != 4]
    touched = lambda held: _chunks(spark, [r for r in held if r[0] % 3 == 0 or r[0] % 10 == 4])
    postings.update(index, touched(rows), touched(now))
    texts = [" ".join(c.split()[:50]) for _, c in rows[:40]] + [None, "", "absent", "pre1 PRE1"]
    asked = spark.createDataFrame([*enumerate(texts), (3, "con2")], "qid long, text string")
    out = []
    shuffled = _shuffled(spark, lambda: out.extend(retrieval.bm25_many(index, _chunks(spark, now), sc.Scope("a", (1,)), asked, 5).collect()))
    got = {}
    for r in out:
        got.setdefault(r.qid, []).append((r.id, r.score))
    for q, text in enumerate(texts):
        scores = _plain_scores(now, f"{text or ''} con2" if q == 3 else text or "")
        best = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        assert sorted(got.get(q, [])) == sorted((i, pytest.approx(scores[i], abs=2e-6)) for i in best), q
    assert shuffled < 3 * sum(len(c) for _, c in rows)
    assert postings.best_many(postings.open_index(spark, str(tmp_path / "none")), _chunks(spark, now), sc.Scope("a", (1,)), asked, 5).count() == 0


def test_erasing_shuffles_no_postings_and_takes_former_texts(spark, tmp_path):
    """Words of a former text that the last one lacks go too; compacting leaves files alone whose spans have nothing to merge."""
    rows = _texts(900, start=-600)
    index = postings.build_index(_chunks(spark, rows), str(tmp_path / "i"))
    former = [(i, f"{c} onlythen{i}") for i, c in rows if i % 6 == 0]
    postings.update(index, _chunks(spark, [r for r in rows if r[0] % 6 == 0]), _chunks(spark, former))
    postings.update(index, _chunks(spark, former), _chunks(spark, [r for r in rows if r[0] % 6 == 0]))
    gone = [r for r in rows if r[0] % 3 == 0]
    held = _chunks(spark, gone)
    shuffled = _shuffled(spark, lambda: postings.erase(index, held))
    assert shuffled < 0.2 * sum(len(c) for _, c in gone)
    left = index.postings.read()
    assert left.where("term LIKE 'onlythen%' OR exists(ids, x -> x % 3 = 0) OR n <> size(ids) OR n = 0").count() == 0
    assert left.where("sign < 0").count() == 0
    stay = [r for r in rows if r[0] % 3]
    want = {(t, i, w.count(t), len(w)) for i, c in stay for w in [c.split()] for t in w}
    plain = lambda: index.postings.read().selectExpr("term", "explode(arrays_zip(ids, tfs, dls)) AS p").select("term", "p.*").collect()
    assert {tuple(r) for r in plain()} == want and len(plain()) == len(want)
    postings.compact(index)
    before = index.postings.names()
    postings.compact(index)
    assert index.postings.names() == before
    assert {tuple(r) for r in plain()} == want
    assert postings.erase(index, _chunks(spark, [(10**6, "never there")])) == []
    assert index.postings.names() == before


def test_changes_of_the_index_shuffle_texts(spark, tmp_path):
    """Less than the texts take, also where ids that lie together come from different partitions; each term of a span is in one row."""
    rows = random.Random(5).sample(_texts(900), 900)
    df = _chunks(spark, rows)
    index = postings.open_index(spark, str(tmp_path / "i"))
    shuffled = _shuffled(spark, lambda: postings.update(index, df.limit(0), df))
    assert shuffled < 0.9 * sum(len(c) for _, c in rows)
    assert index.postings.read().groupBy("tenant", "term", "span", "sign").count().where("count > 1").count() == 0
    for name in index.postings.names():
        terms = pq.read_table(f"{tmp_path}/i/postings/{name}").column("term").to_pylist()
        assert terms == sorted(terms)
