"""Training-order materialisation: tokens in fixed-stride shards, in a keyed random order.

Documents' ids, an end id behind each, are written one after the other and
cut into sequences of ``seq_len`` ids (what is left at the end of an input
partition is padded with the end id). Sequence i of N goes to the global slot
``Feistel(key, i)``: a balanced Feistel network permutes the smallest power of
four that holds N, and cycle-walking repeats it until the result is below N,
so slots are a permutation of 0 to N - 1 that needs no table and no sort.

Shard k holds the slots from k * slots_per_shard on, each ``seq_len`` ids of
``width`` bytes (two where the vocabulary allows it): slot s stands at byte
(s mod slots_per_shard) * stride. So training reads shards from front to back
and resumes from a slot number alone.

Scale: texts are tokenized once; the sequences are written to the shared
folder, since slots need their number, and shuffled once, compressed, to the
range partition that writes their shard. A task holds one shard
(``slots_per_shard`` * stride bytes). Shard files are written under another
name and renamed, and their bytes depend on the table of sequences alone, so
a task that is run again leaves the same file.

Cases: very long texts run on over sequences; a vocabulary with ids over the
stored width is an error; a null or empty text is an end id alone; a table without rows gives no
shard; repeated rows are written each; a null doc_id is written like any
other; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, blocks, saved
from quarry.llm.tokens import END_ID, default_tokenizer, ids_of
from quarry.session import shared_dir, table

SEQ_LEN, SLOTS_PER_SHARD, KEY, ROUNDS = 2048, 4096, 20240601, 6


def _round(x: np.ndarray, key: int, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((key * 0x9E3779B97F4A7C15 + (k + 1) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of indices below n: a permutation of 0 to n - 1 for every key."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = np.asarray(index, np.uint64).copy()
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in range(rounds):
            left, right = right, left ^ (_round(right, key, k) & mask)
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def stored(ids: np.ndarray, width: int) -> bytes:
    """Ids of several sequences, compressed together (words repeat from one to the next)."""
    return pa.Codec("zstd", compression_level=3).compress(ids.astype(f"<u{width}").tobytes(), asbytes=True)


def opened(blob: bytes, n: int, seq_len: int, width: int) -> np.ndarray:
    raw = pa.decompress(blob, decompressed_size=n * seq_len * width, codec="zstd")
    return np.frombuffer(raw, f"<u{width}").reshape(n, seq_len)


#: Sequences in one row of the written table.
BLOCK = 64
META = "local array<long>, n_tokens array<int>, first_doc array<long>, n_docs array<int>, ids_crc32 array<long>, payload binary"
SEQUENCES = "part int, " + META
_KINDS = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def sequences(docs: DataFrame, tokenizer: str, seq_len: int, width: int) -> DataFrame:
    """Consecutive ids of each partition's documents, cut into sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, local = ids_of(tokenizer), TaskContext.get().partitionId(), 0
        buffer, docs_in, have = [], [], 0

        def cut(final: bool) -> list[tuple]:
            nonlocal buffer, docs_in, have, local
            ids = np.concatenate(buffer)
            owner = np.repeat(np.arange(len(buffer)), [len(b) for b in buffer])
            names, rows, at = docs_in, [], 0
            while have - at >= seq_len or (final and at < have):
                own = ids[at : at + seq_len]
                n = len(own)
                whose = owner[at : at + n]
                full = np.append(own, np.full(seq_len - n, END_ID)).astype(np.uint32)
                rows.append((local, n, names[whose[0]], int(whose[-1] - whose[0]) + 1, zlib.crc32(full.astype(f"<u{width}").tobytes()), full))
                local, at = local + 1, at + n
            if at < have:
                keep = int(owner[at])
                buffer, docs_in = [ids[at:][owner[at:] == k] for k in range(keep, len(names))], names[keep:]
            else:
                buffer, docs_in = [], []
            have -= at
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            own = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
            lists = [pa.array([[r[k] for r in block] for block in own], kind) for k, kind in enumerate(_KINDS)]
            payload = pa.array([stored(np.concatenate([r[5] for r in block]), width) for block in own], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int32()), *lists, payload], names=_names(SEQUENCES))

        ready: list[tuple] = []
        for batch in blocks(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buffer.append(np.append(encode(text), np.uint32(END_ID)).astype(np.uint32))
                docs_in.append(doc)
                have += len(buffer[-1])
            if have >= seq_len:
                ready += cut(False)
            if len(ready) >= BLOCK:
                whole = len(ready) // BLOCK * BLOCK
                yield batch_of(ready[:whole])
                ready = ready[whole:]
        ready += cut(True) if have else []
        if ready:
            yield batch_of(ready)

    return arrow_map(docs.select("doc_id", "text"), run, SEQUENCES)


PLACED = "slot long, shard long, byte_offset long, part int, local long, n_tokens int, first_doc long, n_docs int, ids_crc32 long"


DEALT = "shard long, slot array<long>, part int, " + META


def slots(rows: DataFrame, key: int, slots_per_shard: int, seq_len: int, width: int) -> DataFrame:
    """Written sequences dealt to shards: one row for each shard and block of input, compressed together."""
    counts = rows.groupBy("part").agg(F.sum(F.size("local")).alias("n")).orderBy("part").collect()  # one number for each input partition
    base, total = {}, 0
    for r in counts:
        base[r["part"]] = total
        total += r["n"]
    cast = rows.sparkSession.sparkContext.broadcast(base)  # as above: a number for each input partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                some = batch.slice(at, 32)
                columns = [some.column(k).flatten() for k in range(1, 6)]
                sizes = np.diff(some.column(1).offsets.to_numpy())
                part = np.repeat(some.column(0).to_numpy(), sizes)
                ids = np.concatenate([opened(b, n, seq_len, width) for b, n in zip(some.column(6).to_pylist(), sizes.tolist(), strict=True)])
                slot = permuted(np.array([cast.value[p] for p in part.tolist()], np.int64) + columns[0].to_numpy(), total, key)
                out: list[list] = [[] for _ in range(9)]
                for shard, p in sorted(set(zip((slot // slots_per_shard).tolist(), part.tolist(), strict=True))):
                    own = np.flatnonzero((slot // slots_per_shard == shard) & (part == p))
                    for k, v in enumerate((shard, slot[own].tolist(), p, *[c.take(pa.array(own)).to_pylist() for c in columns], stored(ids[own], width))):
                        out[k].append(v)
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), *_KINDS, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=_names(DEALT))

    return arrow_map(rows, run, DEALT)


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(dealt: DataFrame, folder: str, seq_len: int, width: int, slots_per_shard: int) -> DataFrame:
    """Writes every shard's file when the result is computed; returns where each sequence stands."""

    def run(key, pdf):
        import pandas as pd

        system, path = _files(folder)
        system.create_dir(path, recursive=True)
        slot = np.concatenate(pdf["slot"].to_list())
        order = np.argsort(slot)
        ids = np.concatenate([opened(b, len(s), seq_len, width) for b, s in zip(pdf["payload"], pdf["slot"], strict=True)])[order]
        name = shard_name(path, int(key[0]))
        trial = f"{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(trial) as out:
            out.write(ids.tobytes())
        system.move(trial, name)
        placed = pd.DataFrame({"slot": slot, "shard": int(key[0]), "byte_offset": slot % slots_per_shard * seq_len * width, "part": np.repeat(pdf["part"].to_numpy(), [len(s) for s in pdf["slot"]])})
        for c in ("local", "n_tokens", "first_doc", "n_docs", "ids_crc32"):
            placed[c] = pd.array([x for v in pdf[c] for x in v], dtype="Int64")
        return placed

    return dealt.groupBy("shard").applyInPandas(run, PLACED)


def read_slots(folder: str, first: int, count: int, seq_len: int = SEQ_LEN, width: int = 2, slots_per_shard: int = SLOTS_PER_SHARD) -> np.ndarray:
    """Ids of consecutive slots, shard after shard, from any slot on."""
    system, path = _files(folder)
    out, stride = [], seq_len * width
    while count > 0:
        with system.open_input_file(shard_name(path, first // slots_per_shard)) as f:
            f.seek(first % slots_per_shard * stride)
            raw = f.read(min(count, slots_per_shard - first % slots_per_shard) * stride)
        if not raw:
            break
        got = np.frombuffer(raw, f"<u{width}").reshape(-1, seq_len)
        out.append(got)
        first, count = first + len(got), count - len(got)
    return np.concatenate(out) if out else np.empty((0, seq_len), f"<u{width}")


def checked_width(tokenizer: str, width: int) -> int:
    """Bytes of a stored id, unless the vocabulary has ids that need more."""
    most = max(ids_of(tokenizer).tokenizer.get_vocab().values(), default=0)
    if most >> 8 * width:
        raise ValueError(f"ids up to {most} do not fit in {width} bytes")
    return width


def materialized(docs: DataFrame, folder: str, tokenizer: str | None = None, seq_len: int = SEQ_LEN, key: int = KEY, slots_per_shard: int = SLOTS_PER_SHARD, width: int = 2) -> DataFrame:
    tokenizer = tokenizer or default_tokenizer()
    rows = saved(sequences(docs, tokenizer, seq_len, checked_width(tokenizer, width)), "sequences")
    return write_shards(slots(rows, key, slots_per_shard, seq_len, width), folder, seq_len, width, slots_per_shard)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every sequence of the corpus stands; computing it writes the shards."""
    return materialized(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
