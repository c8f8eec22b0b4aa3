"""Odd input that the other tests leave out: long conversations, repeated labels, vocabularies too wide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import byte_cnn, chat_format, decontaminate, packing, quality_rules, training_order
from quarry.llm.common import marked, saved
from quarry.llm.tokens import default_tokenizer


def test_a_very_long_conversation_reads_back(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "x" * (i % 50)) for i in range(3000)] + [(2, 0, None, "a"), (2, 0, "user", "b"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat_format.rendered(chat_format.folded(chat_format.events_of(df))).withColumn("turns", chat_format.read_back(F.col("formatted")))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out.collect()}
    assert got[1] == [(r, t) for _, _, r, t in rows[:3000]]
    assert got[2] == [("", ""), ("", "a"), ("user", "b")]  # equal turns in the order of role and text, nulls first


def test_of_several_labels_the_smallest_counts(spark):
    texts = spark.createDataFrame([(i, f"{'good words here' if i % 2 else '### $$$'} {i}") for i in range(60)], "doc_id long, text string")
    once = [(i, i % 2) for i in range(60)]
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    nets = [byte_cnn.train(texts, labels(rows), steps=20) for rows in (once, once + [(i, 1) for i in range(0, 60, 3)] + [(5, None), (None, 0)])]
    assert all(np.array_equal(a, b) for a, b in zip(nets[0].parameters(), nets[1].parameters(), strict=True))
    doubled = texts.unionByName(texts.limit(10))
    assert byte_cnn.scored(doubled, nets[0]).count() == 70


def test_training_bytes_are_bounded(spark):
    texts = spark.createDataFrame([(i, "w" * 1000) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    net = byte_cnn.train(texts, labels, max_bytes=3500, steps=2)
    assert np.isfinite(net.score([b"w"])).all()


def test_stored_width_must_hold_every_id(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert training_order.checked_width(default_tokenizer(), 2) == 2
    with pytest.raises(ValueError):
        training_order.materialized(df, str(tmp_path), width=1)


def test_very_long_texts_are_read_whole(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(199_980, 199_995)))], "item_id long, text string")
    df = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    hit = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.matched(df, bench).collect()}
    assert hit == {1: (200_000, 15), 2: (0, 0)}
    assert quality_rules.measures(long)[0] == 200_000
    pieces = packing.packed_documents(df).where("doc_id = 1").orderBy("piece").collect()
    assert all(p["length"] == packing.CAPACITY for p in pieces[1:]) and pieces[-1]["start"] + pieces[-1]["length"] > 200_000


def test_packing_stops_where_nothing_is_gained(spark):
    """Pieces over half a sequence: two rounds at most, no task over its share, as many sequences as pieces."""
    n, most = 10_000, 500
    rows = spark.range(n).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "CAST(1100 AS LONG) AS length", "0L AS ids_crc32")
    before = marked()
    packed = packing.pack(saved(rows, "pieces"), 2048, most)
    assert marked() - before <= 1 + 2
    got = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("t")).agg(F.count("*").alias("s"), F.max("t").alias("t"), F.sum("n").alias("n")).head()
    assert (got["s"], got["t"], got["n"]) == (n, 1100, n)
    shards = packed.select(F.expr("(sequence_id >> 30) & 67108863").alias("shard")).groupBy("shard").count().agg(F.max("count"), F.count("*")).head()
    assert shards[0] <= 2 * most and shards[1] >= n // most


def test_packing_gains_from_what_shards_leave(spark):
    """Lengths that fill sequences: what the ends of shards leave is packed anew, close to the bound."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "CAST(pmod(xxhash64(id), 700) + 20 AS LONG) AS length", "0L AS ids_crc32")
    packed = packing.pack(saved(rows, "pieces"), 2048, 400).select("sequence_id", "length")
    total, used = packed.agg(F.sum("length"), F.count_distinct("sequence_id")).head()
    assert used <= -(-total // 2048) * 1.01


def test_many_equal_short_items():
    """2,000 items of one equal word against a million such words: memory by words, not by items times words."""
    import tracemalloc

    search = decontaminate.TestSuffixes([(i, "word") for i in range(2_000)])
    own = [[b"word"] * 1_000_000]
    tracemalloc.start()
    hit, found = decontaminate._hits(search, own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit[:-1].all() and found.tolist() == [[0], [0], [1], [0]]
    assert peak < 500e6
    before = pa.array([[]], pa.list_(pa.struct(decontaminate._MATCH)))
    assert len(decontaminate._joined(before, search, found)[0]) == 2_000


def test_longest_matches_of_runs():
    """A run of one word in item and document: one longest match, not one for each pair of places."""
    search = decontaminate.TestSuffixes([(1, "a " * 300), (2, "b " + "a " * 30 + "c"), (None, "a " * 300)])
    hit, found = decontaminate._hits(search, [[b"x", *[b"a"] * 200, b"c"], [b"b"] + [b"a"] * 12])
    assert sorted(map(tuple, found.T.tolist())) == [(0, 0, 200, 1), (0, 1, 31, 171), (1, 0, 12, 1), (1, 1, 13, 0)]
    assert hit.tolist() == [False, *[True] * 201, False, *[True] * 13, False]
