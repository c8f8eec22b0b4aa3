"""Near copies against all pairs by exact similarity."""

from __future__ import annotations

from itertools import combinations

import pytest


@pytest.mark.parametrize("block", [512, 4, 2])
def test_near_copies_are_those_of_exact_similarity(spark, monkeypatch, block):
    import random

    from quarry.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK_SETS", block)

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts: list[str | None] = [None, "", "  \n", "one", "one"]
    for _ in range(25):  # chains, and copies from just over to far under the threshold
        own = [word() for _ in range(r.choice([12, 60, 150]))]
        texts += [" ".join(own), " ".join(own).upper()]
        for share in (0.005, 0.015, 0.02, 0.03, 0.05, 0.1):
            texts.append(" ".join(word() if r.random() < share else w for w in own))
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[5]), (None, "none like it")]

    def held(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [held(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and 5 * both >= 4 * len(sets[i] | sets[j])):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least: dict[int, int] = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root[k]] = min(d, least.get(root[k], d))
    want = sorted((d is None, d, least.get(root[k])) for k, (d, _) in enumerate(rows) if d is not None)
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted((False, x.doc_id, x.component_id) for x in got if x.doc_id is not None) == want
    assert sorted(str(x.component_id) for x in got if x.doc_id is None) == ["5", "None"]


def test_alike_equals_all_pairs():
    import random

    import numpy as np

    from quarry.llm.simhash import alike

    r = random.Random(2)
    for _ in range(60):
        base = r.sample(range(1000), r.randint(1, 40))
        sets = [np.array(sorted({x if r.random() > 0.08 else r.randrange(1000) for x in base})) for _ in range(r.randint(1, 25))]
        root = list(range(len(sets)))
        for i, j in combinations(range(len(sets)), 2):
            if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
        assert alike(sets) == root


def test_crowds_equal_all_pairs(spark, monkeypatch):
    """One root of many sets in chains and clusters, settled in blocks of a few."""
    import random

    import numpy as np

    from quarry.llm import simhash
    from quarry.llm.common import saved

    r = random.Random(8)
    sets = []
    for _ in range(6):
        base = r.sample(range(10_000), 40)
        for _ in range(r.randint(1, 12)):
            sets.append(np.array(sorted({x if r.random() > 0.06 else r.randrange(10_000) for x in base}), np.uint64))
            if r.random() < 0.5:  # a chain
                base = sets[-1].tolist()
    root = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    rows = [(1, i, bytearray(x.tobytes())) for i, x in enumerate(sets)]
    df = saved(spark.createDataFrame(rows, "root long, own long, held binary"), "test")
    dealt = saved(df.join(simhash._dealt(df.select("root", "own"), 5).drop("root"), "own"), "test")
    got = {x.own: x.label for x in simhash._crowds(dealt, 5).collect()}
    assert [got[i] for i in range(len(sets))] == root
