"""Every stage of the pipeline, and the whole of it, against brute force."""

from __future__ import annotations

import itertools
import random

import pytest

import corpus_pipeline as pipeline
from quarry.llm import byte_cnn, packing
from quarry.llm.tokens import default_tokenizer, ids_of

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    footer, item = "All rights  reserved", [text(14), text(6)]
    rows = [(0, None), (1, ""), (2, "  \n\t"), (3, text(3000)), (None, "a null id " + text(30))]
    for i in range(4, 40):
        rows.append((i, "\n".join(text(r.randint(8, 40)) for _ in range(3)) + (f"\n {footer.upper()} " if i % 3 == 0 else "")))
    base = text(120).split()
    for i in range(40, 60):  # near copies: one word in sixty or so
        own = list(base)
        own[r.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
    rows += [(60, rows[8][1]), (61, rows[8][1]), (62, rows[9][1]), (62, rows[9][1]), (63, text(20) + " " + item[0].title() + " " + text(5)), (64, item[1]), (65, footer)]
    rows += [(i, "### $$$ buy now !!! " * r.randint(3, 9)) for i in range(66, 90)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(d, t, "en" if (d or 0) % 7 else None, "web", None if t is None else len(t), 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 66), 0) for d, _ in rows if d is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def brute_copies(rows):
    """The smallest id of each group of texts whose sets of five-word shingles are alike by 0.8 or more."""
    def sets(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    own, of = [sets(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if own[i] == own[j] or (own[i] and own[j] and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])):
            of[top(j)] = top(i)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(top(i), []).append(row)
    kept = set()
    for members in groups.values():
        ids = [d for d, _ in members if d is not None]
        first = min(ids) if ids else None
        kept |= {(d, t) for d, t in members if d == first}
    return kept


def brute_clean(rows, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for w in map(words, items) for i in range(max(1, len(w) - 9)) if w}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    return {(d, t) for d, t in rows if not hit(t)}


def brute_drop(rows):
    out = []
    lines, _ = brute_drop_keys(rows)
    for d, t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if x.strip(SPACE).lower() not in lines]
        if len(left) == len(own) or "\n".join(left).strip(SPACE):
            out.append((d, "\n".join(left)))
    return out


def brute_drop_keys(rows):
    found = {}
    for k, (_, t) in enumerate(rows):
        for x in {x.strip(SPACE).lower() for x in (t or "").split("\n")} - {""}:
            found.setdefault(x, set()).add(k)
    return {x for x, of in found.items() if len(of) >= 10}, found


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_and_run(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").select(*pipeline.COLUMNS)
    network = byte_cnn.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    score = network.score([(t or "").encode() for _, t in rows])
    kept = [row for row, s in zip(rows, score, strict=True) if s >= 0.5]
    stage = pipeline.classify(spark, docs, path)
    assert pairs(stage) == sorted(kept, key=str) and stage.columns == list(pipeline.COLUMNS)
    assert sum(d is not None and d >= 66 for d, _ in kept) <= 2 <= sum(d is not None and d < 66 for d, _ in kept)

    stage = pipeline.drop_lines(spark, stage, path)
    kept = brute_drop(kept)
    assert pairs(stage) == sorted(kept, key=str) and stage.columns == list(pipeline.COLUMNS)
    assert all(r["n_chars"] in (len(r["text"]), None) for r in stage.collect())

    stage = pipeline.thin_copies(spark, stage, path)
    kept = brute_copies(kept)
    assert pairs(stage) == sorted(kept, key=str) and stage.columns == list(pipeline.COLUMNS)

    stage = pipeline.clean(spark, stage, path)
    kept = brute_clean(kept, items)
    assert pairs(stage) == sorted(kept, key=str) and stage.columns == list(pipeline.COLUMNS)

    whole = pipeline.run(spark, path).collect()
    encode, at, want = ids_of(default_tokenizer()), {}, []
    for d, t in kept:
        total = len(encode(t)) + 1
        want += [(d, k, s, n) for k, (s, n) in enumerate(packing.cut(total, packing.CAPACITY))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"]) for r in whole), key=str) == sorted(want, key=str)
    for r in sorted(whole, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.get(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= packing.CAPACITY


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
