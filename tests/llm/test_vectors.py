"""op11 and op12 against brute force, on ties, odd rows and many parts."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import clustering, hard_negatives
from quarry.llm.queries import ORACLE_SQL, QUERIES
from quarry.plans.compare import differences

SCHEMA = "vec_id long, label int, embedding array<float>, v string, cluster string, score string"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_centroid_clustering"])
def test_equals_duckdb(spark, sf, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], sf) == ""


def _rows(n: int, width: int, levels: int, seed: int) -> list[tuple]:
    """Few different values, so that equal scores and equal vectors abound; a third of the rows is one vector."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = [0.5] * width if i % 3 == 0 else [float(x) / 8 for x in rng.integers(-levels, levels + 1, width)]
        out.append((i, int(rng.integers(0, 3)), v, "x", "y", "z"))
    out[1] = (1, None, *out[1][2:])
    out[2] = (2, 1, None, "x", "y", "z")
    out[4] = (4, 1, [math.nan] * width, "x", "y", "z")
    out[5] = (5, 1, [math.inf] * width, "x", "y", "z")
    out[7] = (7, 1, [None] * width, "x", "y", "z")
    return out


def _floored(rows: list[tuple]) -> list[tuple]:
    return [(i, label, [math.floor(256 * x) for x in v]) for i, label, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def _mined(rows: list[tuple]) -> list[tuple]:
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in _floored(rows) if label is not None]
    out = []
    for a, la, va in kept:
        if a % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v, strict=True)), i, label == la) for i, label, v in kept if i != a))
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            fit = [(n, i) for n, i, same in scored if not same and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, positive, k + 1, i, -p, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("levels", "buckets", "part"), [(1, 256, 1024), (40, 4, 3)])
def test_hard_negatives_equal_brute_force(spark, levels, buckets, part):
    rows = _rows(400, 6, levels, 11)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = hard_negatives.hard_negatives(hard_negatives.integer_rows(df), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), part_anchors=part, buckets=buckets)
    assert sorted(tuple(r) for r in got.collect()) == _mined(rows)
    assert got.count() > 20


def test_hard_negatives_odd(spark):
    mine = lambda rows: [tuple(r) for r in hard_negatives.hard_negatives(hard_negatives.integer_rows(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).collect()]
    assert mine([]) == []
    assert mine([(1, 1, [1.0])]) == []  # no anchor
    assert mine([(50, 1, [1.0])]) == []  # no positive
    # different widths; a null id comes last; repeated rows count each; vectors of size over 2 ** 27 are held there
    got = mine([(50, 1, [1.0, 0.0]), (2, 1, [1.0]), (3, 2, [0.75]), (3, 2, [0.75]), (None, 2, [0.75, 9.0]), (4, 2, [1e30])])
    assert sorted(got) == [(50, 2, 1, 3, 65536, 49152), (50, 2, 2, 3, 65536, 49152), (50, 2, 3, None, 65536, 49152)]


def _clustered(rows: list[tuple], width: int, k: int, rounds: int) -> tuple[dict, list]:
    kept = [(i, v) for i, _, v in _floored(rows) if len(v) == width]
    cents = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, v) for i, v in kept)[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(cents)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if own:
                cents[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return {i: nearest(v) for i, v in kept}, cents


@pytest.mark.parametrize("levels", [1, 30])
def test_clusters_equal_brute_force(spark, levels):
    rows = _rows(300, 4, levels, 3)
    rows[8] = (8, 0, [0.5] * 3, "x", "y", "z")  # another width
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = clustering.clustered(clustering.integer_vectors(df, 4), k=12, rounds=4).collect()
    want, cents = _clustered(rows, 4, 12, 4)
    assert {r["vec_id"]: (r["distance"], r["cluster"]) for r in got} == want
    total = sum(d for d, _ in want.values())
    for r in got:
        assert r["inertia"] == total
        assert r["cluster_inertia"] == sum(d for d, c in want.values() if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()


def test_scan_stops_early_and_ties_go_to_the_smaller():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-500, 500, (40, 3))
    vectors = (centroids[rng.integers(0, 40, 2000)] + rng.integers(-20, 21, (2000, 3))).astype(np.int64)
    full = ((vectors[:, None] - centroids[None]) ** 2).sum(-1)
    ordered = clustering.Ordered(centroids)
    best, least, looked = ordered.assign(vectors, full.argmin(1))
    assert (best == full.argmin(1)).all() and (least == full.min(1)).all()
    assert looked < 0.2 * full.size
    best, _, _ = ordered.assign(vectors, np.full(2000, 39))
    assert (best == full.argmin(1)).all()
    twice = clustering.Ordered(np.array([[0], [4], [0], [2]]))
    assert twice.assign(np.array([[2], [1], [0], [3]]), np.array([1, 3, 2, 3]))[0].tolist() == [3, 0, 0, 1]


def test_clusters_odd(spark):
    few = clustering.clustered(clustering.integer_vectors(spark.createDataFrame([(None, [0.5]), (1, [0.25]), (1, [0.5])], "vec_id long, embedding array<float>"), 1))
    assert sorted((r["vec_id"] or 0, r["cluster"], r["distance"]) for r in few.collect()) == [(0, 1, 0), (1, 0, 0), (1, 1, 0)]
    assert clustering.clustered(clustering.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), 1)).count() == 0
