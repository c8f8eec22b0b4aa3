"""Line dedup through minimal perfect hashes over the lines' hashes.

One pass counts, for every distinct line key, the documents that hold it. The
distinct hashes are dealt to shards, and each shard gets a minimal perfect
hash with two compact arrays beside it: 64-bit fingerprints and saturated
counts. A second pass reads the documents again and probes the arrays for
every line; lines are never joined, and texts are never shuffled.

Exactness: a key's 128-bit XXH3 is split in two; the first half picks shard
and place, the second half is the fingerprint. Keys that are not in a shard
are told from those that are by all 128 bits.

Scale: a line found in fewer than ``min_docs`` documents is never dropped, so
shards keep only keys that reach the bound before the perfect hash is built:
at most (lines / min_docs) keys of 9 bytes and a fraction. Shards are rows of
a table in the shared folder. Documents do not read all of them into memory:
every task holds one block of shards (``BLOCK_BYTES``) at a time and, where
there are more blocks, takes the documents' hashes through each in turn.

Cases: null or empty text is one empty line, whose empty key counts only if
``min_chars`` is 0; repeated lines of one document count once; repeated rows
count each, as documents of their own; very long texts and lines are taken
whole; a null doc_id stays null; other columns, whatever their names, are not
read. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, blocks, carried, saved
from quarry.session import table

MIN_DOCS, MIN_CHARS = 10, 1
#: White space that keys are stripped of, and the bytes that are lower-cased.
SPACE = b" \t\n\x0b\x0c\r"
#: Mean keys for each displacement, and places for each key, of a shard's hash.
KEYS_A_BUCKET = 4
SHARD_KEYS = 200_000
BLOCK_BYTES = 64 << 20

_M = (1 << 64) - 1


def _hashes(lines: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes as (n, 2) unsigned numbers, and which lines have a long enough key."""
    digest, out, use = xxhash.xxh3_128_digest, [], np.ones(len(lines), bool)
    for i, line in enumerate(lines):
        key = line.strip(SPACE).lower()
        if len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars):
            use[i] = False
        out.append(digest(key))
    return np.frombuffer(b"".join(out), ">u8").reshape(-1, 2).astype(np.uint64), use


def _mix(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A hash of 64-bit numbers, changed by a seed (as in splitmix64)."""
    with np.errstate(over="ignore"):
        x = h + (np.asarray(seed, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _range(h: np.ndarray, n: int) -> np.ndarray:
    """Even numbers below n (under 2^32) from the hashes' upper halves."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def build_hash(h: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash over distinct 64-bit numbers.

    Keys fall in buckets; from the fullest bucket on, each takes the first
    displacement that sends all its keys to free places among exactly as many
    places as there are keys. All buckets of one size are tried together.
    """
    n = len(h)
    buckets = max(1, -(-n // KEYS_A_BUCKET))
    of = _range(_mix(h, 0), buckets)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(buckets + 1))
    size = np.diff(starts)
    displacement, taken = np.zeros(buckets, np.uint32), np.zeros(n, bool)
    for k in range(int(size.max(initial=0)), 0, -1):
        left = np.flatnonzero(size == k)
        keys = h[order[starts[left][:, None] + np.arange(k)]]
        d = 0
        while len(left):
            d += 1
            place = _range(_mix(keys, d), n)
            fits = ~taken[place].any(axis=1)
            if k > 1:
                ordered = np.sort(place, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            at = np.flatnonzero(fits)
            if len(at):  # of buckets that want the same place the first has it
                flat, whose = place[at].ravel(), np.repeat(np.arange(len(at)), k)
                by = np.argsort(flat, kind="stable")
                clash = np.zeros(len(at), bool)
                same = flat[by][1:] == flat[by][:-1]
                clash[whose[by][1:][same]] = True
                won = at[~clash]
                taken[place[won].ravel()] = True
                displacement[left[won]] = d
                stay = np.ones(len(left), bool)
                stay[won] = False
                left, keys = left[stay], keys[stay]
    return displacement


def places(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    bucket = _range(_mix(h, 0), len(displacement))
    return _range(_mix(h, displacement[bucket]), n)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents of every distinct key: h1, h2 (its hash), n_docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            held = []
            for text in batch.column(0).to_pylist():
                h, use = _hashes((text or "").encode().split(b"\n"), min_chars)
                held.append(np.unique(h[use], axis=0) if len(h) > 1 else h[use])
            h = np.concatenate(held)
            order = np.lexsort((h[:, 1], h[:, 0]))
            h = h[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]).any(axis=1)
            n = np.diff(np.append(np.flatnonzero(first), len(h)))
            h = h[first].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n.astype(np.int64))], names=["h1", "h2", "n"])

    rows = arrow_map(docs.select("text"), run, "h1 long, h2 long, n long")
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"))


def shard_arrays(counts: DataFrame, shards: int) -> DataFrame:
    """A row for each shard that has keys: its hash, fingerprints and counts (1 to 255, saturated)."""

    def run(key, pdf):
        import pandas as pd

        h = pdf["h1"].to_numpy(np.int64).view(np.uint64)
        unique, at = np.unique(h, return_index=True)
        if len(unique) != len(h):  # equal halves of different hashes: keep the others aside
            rest = np.setdiff1d(np.arange(len(h)), at)
            spare = pdf.iloc[rest][["h1", "h2"]].to_numpy(np.int64).tobytes()
        else:
            spare = b""
        d = build_hash(unique)
        place = places(unique, d, len(unique))
        prints, number = np.zeros(len(unique), np.uint64), np.zeros(len(unique), np.uint8)
        prints[place] = pdf["h2"].to_numpy(np.int64).view(np.uint64)[at]
        number[place] = np.minimum(pdf["n_docs"].to_numpy(np.int64)[at], 255)
        return pd.DataFrame({"shard": [int(key[0])], "n": [len(unique)], "displacement": [d.tobytes()], "prints": [prints.tobytes()], "counts": [number.tobytes()], "spare": [spare]})

    dealt = counts.withColumn("shard", (F.shiftrightunsigned("h1", 40) % shards).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, "shard int, n long, displacement binary, prints binary, counts binary, spare binary")


class Arrays:
    """Shards held in memory to be probed."""

    def __init__(self, rows: list[dict], shards: int):
        self.shards = shards
        self.of = {r["shard"]: (r["n"], np.frombuffer(r["displacement"], np.uint32), np.frombuffer(r["prints"], np.uint64), np.frombuffer(r["counts"], np.uint8), {tuple(x) for x in np.frombuffer(r["spare"], np.int64).reshape(-1, 2).tolist()}) for r in rows}

    def count(self, h: np.ndarray) -> np.ndarray:
        """The saturated count of each hash, 0 where it has no place."""
        out = np.zeros(len(h), np.uint8)
        if not self.of:
            return out
        shard = ((h[:, 0] >> np.uint64(40)) % np.uint64(self.shards)).astype(np.int64)
        for s in np.unique(shard).tolist():
            if s in self.of:
                n, displacement, prints, counts, spare = self.of[s]
                at = np.flatnonzero(shard == s)
                place = places(h[at, 0], displacement, n)
                hit = prints[place] == h[at, 1]
                out[at[hit]] = counts[place[hit]]
                if spare:
                    pairs = h[at].view(np.int64).tolist()
                    out[[i for i, p in zip(at.tolist(), pairs, strict=True) if tuple(p) in spare]] = 255
        return out


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, int]:
    """The shards of keys found in min_docs documents or more (written), and how many shards there are."""
    counts = saved(line_counts(docs, min_chars).where(F.col("n_docs") >= min_docs), "lines")
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    return saved(shard_arrays(counts, shards), "line-arrays"), shards


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its frequent lines gone: doc_id, text, n_lines, n_dropped, and carry as a struct."""
    spark = docs.sparkSession
    arrays, shards = frequent_lines(docs, min_docs, min_chars)
    sizes = {r["shard"]: r["bytes"] for r in arrays.select("shard", F.expr("length(displacement) + length(prints) + length(counts) + length(spare)").alias("bytes")).collect()}
    groups: list[list[int]] = [[]]
    held = 0
    for shard, size in sorted(sizes.items()):
        if groups[-1] and held + size > block_bytes:
            groups.append([])
            held = 0
        groups[-1].append(shard)
        held += size
    # Each block is bounded by block_bytes, so each broadcast is; with more than one, the marks of
    # earlier blocks travel with the text as one bit a line.
    rows, schema, names = carried(docs, carry)
    rows = rows.select("doc_id", "text", F.lit(None).cast("binary").alias("marks"), *names)
    for k, group in enumerate(groups):
        held_rows = [r.asDict() for r in arrays.where(F.col("shard").isin(group)).collect()] if group else []
        cast = spark.sparkContext.broadcast(held_rows)
        last = k == len(groups) - 1

        def run(batches: Iterator[pa.RecordBatch], cast=cast, last=last) -> Iterator[pa.RecordBatch]:
            probe = Arrays(cast.value, shards)
            for batch in blocks(batches):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                lines = [t.encode().split(b"\n") for t in texts]
                h, use = _hashes([x for own in lines for x in own], min_chars)
                drop = (probe.count(h) > 0) & use
                ends = np.cumsum([len(own) for own in lines])
                bits = [drop[e - len(own) : e] for e, own in zip(ends, lines, strict=True)]
                marks = batch.column(2).to_pylist()
                bits = [b if m is None else b | np.unpackbits(np.frombuffer(m, np.uint8), count=len(b)).astype(bool) for b, m in zip(bits, marks, strict=True)]
                if last:
                    kept = [t if not b.any() else b"\n".join([x for x, gone in zip(own, b.tolist(), strict=True) if not gone]).decode() for t, own, b in zip(texts, lines, bits, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array([len(b) for b in bits], pa.int64()), pa.array([int(b.sum()) for b in bits], pa.int64()), *batch.columns[3:]], names=["doc_id", "text", "n_lines", "n_dropped", *names])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()), *batch.columns[3:]], names=["doc_id", "text", "marks", *names])

        rows = arrow_map(rows, run, ("doc_id long, text string, n_lines long, n_dropped long" if last else "doc_id long, text string, marks binary") + schema)
        if not last:  # blocks follow one another; a stage never holds two
            rows = saved(rows, "marked")
    return rows


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


#: Equal rows by plain SQL, for the checks against DuckDB.
ORACLE_OP7 = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.k) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.k = f.k GROUP BY doc_id
"""
