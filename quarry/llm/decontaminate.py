"""Benchmark decontamination by suffix arrays over the training words.

The corpus is cut into shards (blocks of whole documents). Each shard gets the
suffix array of all its words, by difference cover, and every test suffix of a
window or more is binary-searched in every shard's array, word by word: the
suffixes that share its first ``WINDOW`` words form one interval, whose members
are verbatim occurrences. Occurrences that follow one another on both sides are
one longer match, so the longest matches and their locations come out of the
same search.

Words are numbered by the test items' vocabulary, all others are 0, so two
words are equal just when their non-zero numbers are: there is no hashing and
no false match.

Scale: one pass over the documents without a shuffle; what is sent along is
the test set, whose size is checked (``MAX_TEST_WORDS``); larger test sets
are taken in parts of that size, one after another: each part is one pass that
leaves its hits with the texts for the next, so neither the driver nor a worker
ever holds two parts. A task holds the places of every different window once,
whatever the number of items or of places in items that have it; a result holds one
element for each pair of item and document that match, never one for each
occurrence.

Cases: null or empty texts have no words; an item with fewer words than the
window is one window, an item without words none; repeated items and rows
count each; a null item_id shows nowhere; very long texts are searched whole;
without documents there are no rows, without items no hits; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, blocks, carried, saved
from quarry.llm.suffix_dedup import suffix_order
from quarry.session import table

WINDOW = 10
#: Words of test items that are held at a time by a worker.
MAX_TEST_WORDS = 2_000_000
#: Words of one suffix array; a longer block of documents gets several, which overlap by a window.
SHARD_WORDS = 1 << 20

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (bytes.lower changes A-Z alone; UTF-8's other bytes are all over 7F)."""
    return WORD.findall((text or "").encode().lower())


class TestSuffixes:
    """Every suffix of the test items that holds a window, ready to be searched for by its first words.

    Items of equal words are one sequence and equal windows one class, however many items hold them.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        classes: dict[int, dict[bytes, int]] = {}
        items_of: dict[bytes, list[int]] = {}
        for at, (_, text) in enumerate(items):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.uint32)
            if len(ids):
                items_of.setdefault(ids.tobytes(), []).append(at)
        self.items_of = list(items_of.values())
        #: by sequence, the class of the window at each place, and the length of its windows
        self.sequences: list[tuple[list[int], int]] = []
        #: by class, the sequences that hold it
        self.holders: list[list[int]] = []
        for q, raw in enumerate(items_of):
            n = min(window, len(raw) // 4)
            of = classes.setdefault(n, {})
            own = []
            for s in range(len(raw) // 4 - n + 1):
                c = of.setdefault(raw[4 * s : 4 * (s + n)], len(self.holders))
                if c == len(self.holders):
                    self.holders.append([])
                if self.holders[c][-1:] != [q]:
                    self.holders[c].append(q)
                own.append(c)
            self.sequences.append((own, n))
        # by length: the first words of each different suffix, and its class
        self.of_length = {n: (np.frombuffer(b"".join(of), np.uint32).reshape(-1, n), np.array(list(of.values()))) for n, of in classes.items()}
        self.item_ids = pa.array([i for i, _ in items], pa.int64())

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(length of a window, its class, places in ids of its occurrences), over one block.

        ids: the block's words in order, with at least one 0 after each document.
        """
        widest = max(self.of_length, default=0)
        for begin in range(0, len(ids) if widest else 0, SHARD_WORDS):
            shard = ids[begin : begin + SHARD_WORDS + widest - 1]
            used, words = np.unique(shard, return_inverse=True)
            array = suffix_order(words)
            first = words[array]
            padded = np.append(words, np.full(widest, -1))
            for n, (suffixes, of) in self.of_length.items():
                asked = np.minimum(np.searchsorted(used, suffixes), len(used) - 1)
                row = np.flatnonzero((used[asked] == suffixes).all(axis=1))
                low, high = np.searchsorted(first, asked[row, 0], "left"), np.searchsorted(first, asked[row, 0], "right")
                for depth in range(1, n):
                    at = padded[depth:]
                    low, high = (_bound(at, array, asked[row, depth], low, high, right) for right in (False, True))
                    kept = low < high
                    row, low, high = row[kept], low[kept], high[kept]
                for r, a, b in zip(row.tolist(), low.tolist(), high.tolist(), strict=True):
                    places = array[a:b] + begin
                    places = places[places < begin + SHARD_WORDS]  # later ones are found in the next array
                    if len(places):
                        yield n, int(of[r]), places


def _bound(at: np.ndarray, array: np.ndarray, word: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Between low and high of the suffix array, the first place whose word is not under ``word`` (or, right, is over it)."""
    low, high = low.copy(), high.copy()
    while True:
        going = np.flatnonzero(low < high)
        if not len(going):
            return low
        middle = (low[going] + high[going]) >> 1
        held = at[array[middle]]
        before = held <= word[going] if right else held < word[going]
        low[going[before]] = middle[before] + 1
        high[going[~before]] = middle[~before]


def _hits(search: TestSuffixes, own_words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Which words are hit, all documents' one after the other with a False behind each, and for every document
    and sequence that match one column of (document, sequence, longest match in words, its first word in the document)."""
    number = search.number.get
    parts = [np.array([*map(number, own, _ZEROS), 0], np.uint32) for own in own_words]
    ids = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    cover = np.zeros(len(ids) + 1, np.int64)
    places_of: dict[int, list[np.ndarray]] = {}
    for n, c, places in search.search(ids):
        cover[places] += 1
        cover[places + n] -= 1
        places_of.setdefault(c, []).append(places)
    found = {c: np.sort(np.concatenate(places)) for c, places in places_of.items()}
    longest = [_longest(q, *search.sequences[q], found, ends) for q in sorted({q for c in found for q in search.holders[c]})]
    matches = np.concatenate([np.empty((4, 0), np.int64), *longest], axis=1)
    matches[3] -= np.append(0, ends)[matches[0]]
    return np.cumsum(cover[:-1]) > 0, matches


def _longest(sequence: int, classes: list[int], n: int, places_of: dict[int, np.ndarray], ends: np.ndarray) -> np.ndarray:
    """The longest match of one sequence in every document that it matches, the first of equal ones.

    Windows that follow one another on both sides are one match: the length of each is carried from one window to
    the next, so what is held are the places of one window, never all pairs of places.
    """
    over: list[np.ndarray] = []
    held = 0
    none = np.empty(0, np.int64)
    at, run = none, none
    for c in [*classes, -1]:
        places = places_of.get(c, none)
        before = np.minimum(np.searchsorted(at, places - 1), max(len(at) - 1, 0))
        goes_on = at[before] == places - 1 if len(at) else np.zeros(len(places), bool)
        length = np.ones(len(places), np.int64)
        length[goes_on] += run[before[goes_on]]
        done = np.ones(len(at), bool)
        done[before[goes_on]] = False
        if done.any():
            first = at[done] - run[done] + 1
            over.append(np.stack([np.searchsorted(ends, first, "right"), np.full(len(first), sequence), run[done] + n - 1, first]))
            held += len(first)
            if held > 1 << 20:
                over = [_best(over)]
                held = over[0].shape[1]
        at, run = places, length
    return _best(over)


def _best(rows: list[np.ndarray]) -> np.ndarray:
    """Of (document, sequence, words, place) of one sequence: the longest by document, the first of equal ones."""
    all_ = np.concatenate([np.empty((4, 0), np.int64), *rows], axis=1)
    all_ = all_[:, np.lexsort((all_[3], -all_[2], all_[0]))]
    return all_[:, np.diff(all_[0], prepend=-1) != 0]


_ZEROS = itertools.repeat(0)
_opened: dict[tuple, TestSuffixes] = {}


def _open(load, window: int) -> TestSuffixes:
    """A worker keeps the part of the test set that it searched for last."""
    name, items = load.value
    if (name, window) not in _opened:
        _opened.clear()
        _opened[name, window] = TestSuffixes(items, window)
    return _opened[name, window]


_MATCH = [("item_id", pa.int64()), ("words", pa.int32()), ("at", pa.int32())]


def _joined(before: pa.ListArray, search: TestSuffixes, found: np.ndarray) -> pa.ListArray:
    """The matches of each document so far, and those found now: one for each item of a sequence."""
    per = [np.array(search.items_of[q]) for q in found[1].tolist()]
    times = np.array([len(p) for p in per], np.int64)
    doc, words, at = (np.repeat(found[i], times) for i in (0, 2, 3))
    items = search.item_ids.take(pa.array(np.concatenate([np.empty(0, np.int64), *per])))
    old = before.flatten()
    olds = before.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    both = [pa.concat_arrays([old.field(i), pa.array(new).cast(t)]) for i, (new, (_, t)) in enumerate(zip((items, words, at), _MATCH, strict=True))]
    order = np.argsort(np.append(np.repeat(np.arange(len(before)), olds), doc), kind="stable")
    offsets = np.append(0, np.cumsum(olds + np.bincount(doc, minlength=len(before)))).astype(np.int32)
    values = pa.StructArray.from_arrays([b.take(pa.array(order)) for b in both], names=[name for name, _ in _MATCH])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


MATCHED = "doc_id long, text string, n_words long, n_hit long, marks binary, matches array<struct<item_id:long,words:int,at:int>>"


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_test_words: int = MAX_TEST_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its hit words and, for each matching item, the longest verbatim match."""
    spark = docs.sparkSession
    rows, schema, carried_names = carried(docs, carry)
    none = F.array().cast("array<struct<item_id:long,words:int,at:int>>")
    rows = rows.select("doc_id", "text", F.lit(None).cast("binary").alias("marks"), none.alias("matches"), *carried_names)
    size = benchmark.agg(F.sum(F.length("text"))).head()[0] or 0
    parts = max(1, -(-size // (max_test_words * 8)))
    tests = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    for k in range(parts):  # each part is bounded by max_test_words, so each may be sent to all
        own = tests if parts == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        load = spark.sparkContext.broadcast((uuid.uuid4().hex, sorted(((r["item_id"], r["text"]) for r in own.collect()), key=str)))

        def run(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                own_words = [words_of(t) for t in batch.column(1).to_pylist()]
                search = _open(load, window)
                hit, found = _hits(search, own_words)
                matches = _joined(batch.column(3), search, found)
                ends = np.cumsum([len(own) + 1 for own in own_words])
                bits = [hit[e - len(own) - 1 : e - 1] for e, own in zip(ends.tolist(), own_words, strict=True)]
                bits = [b if m is None else b | np.unpackbits(np.frombuffer(m, np.uint8), count=len(b)).astype(bool) for b, m in zip(bits, batch.column(2).to_pylist(), strict=True)]
                counts = [pa.array([len(b) for b in bits], pa.int64()), pa.array([int(b.sum()) for b in bits], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, pa.array([np.packbits(b).tobytes() if b.any() else None for b in bits], pa.binary()), matches, *batch.columns[4:]], names=["doc_id", "text", "n_words", "n_hit", "marks", "matches", *carried_names])

        rows = arrow_map(rows, run, MATCHED + schema)
        if k < parts - 1:
            rows = saved(rows, "matched").select("doc_id", "text", "marks", "matches", *carried_names)
    return rows.drop("marks")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents without those that hold any window of a test item."""
    return matched(docs, benchmark, window, carry=carry).where(F.col("n_hit") == 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct(F.transform(F.filter("matches", lambda m: m["item_id"].isNotNull()), lambda m: m["item_id"].cast("string"))))
    return rows.select("doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_OP3 = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iwin AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[s:s+n-1], ' ') AS k FROM (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, n, p, array_to_string(w[p:p+n-1], ' ') AS k FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM iwin) WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT doc_id, item_id, d.n, p FROM dwin d JOIN iwin i ON d.k = i.k AND d.n = i.n),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
