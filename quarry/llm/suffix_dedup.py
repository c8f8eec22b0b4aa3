"""Exact substring dedup: suffix arrays by difference cover, in shards that equal strings share.

A byte goes where a string of ``length`` bytes covers it that starts earlier
too (in a document of smaller id, or earlier in the same one). Strings are
judged on the input as it is.

1. Anchors. Every window of ``length`` bytes names one of the 32-byte strings
   in it, the one with the smallest hash (the leftmost of equals). Equal
   windows name equal strings at equal places, so windows can only repeat
   among those with one anchor. Consecutive windows with one anchor are a
   unit: a run of 35 windows on average, whose text is 134 bytes.
2. Equal units are collapsed where they are found, before anything is
   shuffled: all but the first of a map task are repeats. The rest meets by
   anchor; anchors found once are done with. Units count as equal where both
   the anchor's hash and the unit's, of different kinds, agree in 64 bits.
3. The texts of the remaining units, each different one once, go to shards by
   anchor. A shard sorts all its suffixes by the difference-cover algorithm:
   sampled triples (places 1 and 2 of every 3) are sorted and named, the
   string of names is solved by recursion, the remaining suffixes are sorted
   by (symbol, rank that follows), and the sorted lists are merged. Neighbours
   in the array are compared by their first ``length`` bytes; of each run of
   equals all but the earliest place repeat.
4. Repeated windows go back to their documents, which are cut.

Sorting all suffixes of the corpus in one array would send each place around
some thirty times; here only text that may repeat is sorted, once for each
different unit. The number of shards follows the bytes of the corpus
(``PART_TEXT`` each), so a task's memory does not grow with it.

Skew. An anchor may have many different units (contexts of one very common
passage, or a large group of near copies). Where they exceed a suffix array's
size, their windows are named anew by longer anchors, in up to three more
rounds; the last anchor is the window itself, of which there is but one.
An anchor that has many units within one map task already is dealt by unit
instead of by anchor, so its units never meet in one place.

Cases: null and empty texts have no bytes; texts shorter than the window lose
none; very long texts are taken in parts that overlap by a window; a table
without rows gives none; rows that repeat a doc_id are one document in the
order, and rows with one doc_id and one text get one result each; a null
doc_id is the smallest; other columns, whatever their names, are not read;
cutting may leave bytes that are no UTF-8, so kept bytes are binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, blocks, partitions, saved
from quarry.session import table

LENGTH, ANCHOR = 100, 32
#: Window starts that are hashed together; a place takes 21 bits.
PART = 1 << 18
#: Symbols that one suffix array is made for at a time.
SHARD_SYMBOLS = 1 << 19
#: Bytes of text for each shard.
PART_TEXT = 16 << 20
#: Different units of one anchor in one map task beyond which they are dealt by unit.
LOUD_UNITS = 1_000
NULL_ID = -(1 << 63)

_r = np.random.default_rng(32)
_SYMBOL = _r.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def levels(length: int) -> list[int]:
    """Anchor lengths of the rounds: each takes half of what is left of the window, the last all of it."""
    first = min(ANCHOR, length)
    return sorted({first, length - (length - first) // 2, length - (length - first) // 4, length})


def anchors(raw: bytes, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Units of all windows in raw[start:end] of several documents that lie one after the other.

    Returns (anchor hash, unit hash, start of the first window, windows).
    """
    text = np.frombuffer(raw, np.uint8)
    empty = np.empty(0, np.int64)
    n = len(text)
    if n < length:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    anchor = min(anchor, length)
    with np.errstate(over="ignore"):
        # hash of `anchor` bytes from each place, by doubling
        h, have, done, total = _SYMBOL[text], 1, 0, np.zeros(n - anchor + 1, np.uint64)
        rest = anchor
        while rest:
            if rest & 1:
                total = total * np.uint64(pow(_BASE, have, 1 << 64)) + h[done : done + len(total)]
                done += have
            rest >>= 1
            if rest:
                h = h[:-have] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have:]
                have *= 2
        mixed = _mixed(total)
        places = np.arange(len(mixed), dtype=np.uint64)
        least, have, span = (mixed & ~np.uint64((1 << 21) - 1)) | places, 1, length - anchor + 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: n - length + 1], least[span - have : span - have + n - length + 1])
        at = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    use = ends - starts >= length
    np.add.at(inside, starts[use], 1)
    np.add.at(inside, ends[use] - length + 1, -1)
    inside = np.cumsum(inside)[: n - length + 1] > 0
    head = np.zeros(n, bool)
    head[starts[use]] = True
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | head[1 : n - length + 1]
    first = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    last = np.flatnonzero(stop)
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    unit = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
    return mixed[at[first]], unit, first, last - first + 1


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffix array of up to 2^21 - 4 symbols below 2^21 - 2, by difference cover."""
    n = len(s)
    t = np.append(s.astype(np.int64) + 1, np.zeros(3, np.int64))
    return _merged(t, n, _sample_ranks(t, n, int(t.max()).bit_length() if n else 1)) if n >= 4 else _few(t, n)


def _few(t: np.ndarray, n: int) -> np.ndarray:
    return np.array(sorted(range(n), key=lambda i: t[i:n].tolist()), np.int64)


def _sample_ranks(t: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Ranks from 1 of the suffixes at places 1 and 2 of every 3; 0 elsewhere and past the end. Symbols have ``bits`` bits."""
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    m = len(sample)
    triple = (t[sample] << (2 * bits)) | (t[sample + 1] << bits) | t[sample + 2]
    place = m.bit_length()
    if 3 * bits + place <= 63:  # triple and place sort as one number
        both = np.sort((triple << place) | np.arange(m))
        order, ordered = both & ((1 << place) - 1), both >> place
    else:
        order = np.argsort(triple)
        ordered = triple[order]
    name = np.empty(m, np.int64)
    name[order] = np.cumsum(np.append(1, ordered[1:] != ordered[:-1]))
    top = int(name[order[-1]])
    if top < m:
        reduced = np.append(name, np.zeros(3, np.int64))
        solved = _merged(reduced, m, _sample_ranks(reduced, m, top.bit_length())) if m >= 4 else _few(reduced, m)
        name[solved] = np.arange(1, m + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    return rank


def _merged(t: np.ndarray, n: int, rank: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the ranks of the sampled ones."""
    b0 = np.arange(0, n, 3)
    key0 = (t[b0] << 21) | rank[b0 + 1]
    o0 = np.argsort(key0)
    b0, key0 = b0[o0], key0[o0]
    at = np.flatnonzero(rank[:n])
    sampled = np.full(int(rank.max()) + 1, -1)
    sampled[rank[at]] = at
    sampled = sampled[sampled >= 0]
    one = sampled % 3 == 1
    b1, b2 = sampled[one], sampled[~one]
    key1 = (t[b1] << 21) | rank[b1 + 1]  # against b0: (symbol, rank that follows)
    long0 = (t[b0] << 42) | (t[b0 + 1] << 21) | rank[b0 + 2]  # against b0: two symbols, rank
    long2 = (t[b2] << 42) | (t[b2 + 1] << 21) | rank[b2 + 2]
    # a suffix of b0 stands behind the sampled ones that come before it
    place0 = np.arange(len(b0)) + np.searchsorted(key1, key0) + np.searchsorted(long2, long0)
    out = np.empty(n, np.int64)
    out[place0] = b0
    rest = np.ones(n, bool)
    rest[place0] = False
    out[rest] = sampled
    return out


def repeated_windows(text: np.ndarray, windows: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(unit, window in it) of all windows that also start earlier, by one suffix array.

    text: the units' texts one after the other, each of windows + length - 1
    bytes; doc and place: where each unit's first window stands.
    """
    sizes = windows + length - 1
    begin = np.cumsum(sizes) - sizes
    unit_at = np.repeat(np.arange(len(windows)), sizes)
    order = suffix_order(text)
    unit = unit_at[order]
    use = order - begin[unit] < windows[unit]
    order, unit = order[use], unit[use]
    width = min(8, length)
    padded = np.append(text, np.zeros(8, np.uint8))
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width))
    word = word.view("<u8").ravel() if width == 8 else word.view(f"S{width}").ravel()
    alike = np.arange(1, len(order))
    for at in [*range(0, length - width + 1, width), length - width]:
        alike = alike[word[order[alike] + at] == word[order[alike - 1] + at]]
    same = np.zeros(len(order) + 1, bool)
    same[alike] = True
    met = same[:-1] | same[1:]  # in a run of equals
    group, order, unit = np.cumsum(~same[:-1])[met], order[met], unit[met]
    shift = order - begin[unit]
    where = place[unit] + shift
    by = np.lexsort((where, doc[unit], group))
    first = np.ones(len(by), bool)
    first[1:] = group[by][1:] != group[by][:-1]
    head = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    later = (doc[unit[by]] != doc[unit[head]]) | (where[by] != where[head])
    return unit[by[later]], shift[by[later]]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, byte by byte and compressed."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c, np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, rows: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=rows * columns * 8, codec="zstd"), np.uint8).reshape(columns, 8, rows)
    return [np.ascontiguousarray(c.T).reshape(-1).view(np.int64) for c in raw]


BLOB = "part int, kind int, n long, payload binary"
#: Kinds of blobs and rows: units to be compared, units to be named anew, windows known to repeat, anchors dealt by unit.
SORT, HOT, REPEATS, MARK = 0, 1, 2, 3


def _blobs(part: np.ndarray, kind: int, columns: list[np.ndarray], text: tuple[np.ndarray, np.ndarray] | None = None, length: int = 0) -> list[tuple[int, int, int, bytes]]:
    """One blob for each part that has rows, rows in the given order; text: bytes and where each row's begin."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    parts, at = np.unique(part[order], return_index=True)
    out = []
    for p, own in zip(parts.tolist(), np.split(order, at[1:]), strict=True):
        numbers = [c[own] for c in columns]
        out.append((p, kind, len(own), _text_blob(numbers, _taken(text[0], text[1][own], numbers[-1] + length - 1)) if text else _packed(*numbers)))
    return out


def _blob_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "kind", "n", "payload"])


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of a text's parts, which overlap by a window."""
    for s in range(0, max(1, len(text) - length + 1), PART):
        yield s, text if len(text) <= PART + length - 1 else text[s : s + PART + length - 1]


def _texts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(id, row, start, bytes) of the parts of whole texts."""
    for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        for s, piece in _pieces((text or "").encode(), length):
            yield doc, row, s, piece


def _units(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(id, row, start, bytes) of units that are to be named anew."""
    for n, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        (_, doc, row, start, windows), text = _with_text(payload, n, 5, length)
        raw, at = text.tobytes(), 0
        for d, r, s, w in zip(doc.tolist(), row.tolist(), start.tolist(), windows.tolist(), strict=True):
            yield d, r, s, raw[at : at + w + length - 1]
            at += w + length - 1


def _text_blob(columns: list[np.ndarray], text: np.ndarray) -> bytes:
    """Columns of numbers, the last one windows, and the units' texts one after the other."""
    texts = pa.compress(text.tobytes(), codec="zstd", asbytes=True)
    return len(texts).to_bytes(8, "little") + texts + _packed(*columns)


def _with_text(payload: bytes, n: int, columns: int, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    size = int.from_bytes(payload[:8], "little")
    own = _unpacked(payload[8 + size :], n, columns)
    return own, np.frombuffer(pa.decompress(payload[8 : 8 + size], decompressed_size=int((own[-1] + length - 1).sum()), codec="zstd"), np.uint8)


def _taken(text: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """text[begin : begin + size] of several, one after the other."""
    return text[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


#: Units that a task holds before it sends them; fewer where their texts go along.
FLUSH_UNITS, FLUSH_WITH_TEXT = 2_000_000, 200_000


def _find(parts: int, length: int, anchor: int, again: bool):
    """Units of each task's texts, equal ones once, in blobs for the parts where they meet.

    From the second round on, the texts are those of earlier units, and units take theirs along.
    """
    most = FLUSH_WITH_TEXT if again else FLUSH_UNITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        joined: list[tuple[int, int, int, bytes]] = []
        count = size = 0

        def close() -> int:
            doc, row, base = (np.array(c, np.int64) for c in list(zip(*joined, strict=True))[:3])
            raw = b"".join(j[3] for j in joined)
            ends = np.cumsum([len(j[3]) for j in joined])
            starts = np.append(0, ends[:-1])
            name, unit, first, windows = anchors(raw, starts, ends, length, anchor)
            own = np.searchsorted(starts, first, side="right") - 1
            held.append([name.view(np.int64), unit.view(np.int64), doc[own], row[own], first - starts[own] + base[own], windows])
            if again:
                held[-1].append(_taken(np.frombuffer(raw, np.uint8), first, windows + length - 1))
            return len(first)

        pieces = (piece for batch in batches for piece in _units(batch, length)) if again else (piece for batch in blocks(batches) for piece in _texts(batch, length))
        for piece in pieces:
            if len(piece[3]) < length:
                continue
            if joined and size + len(piece[3]) > PART + length:
                count, joined, size = count + close(), [], 0
                if count >= most:
                    yield _blob_batch(_collapsed(held, parts, length))
                    held, count = [], 0
            joined.append(piece)
            size += len(piece[3])
        if joined:
            count += close()
        if count:
            yield _blob_batch(_collapsed(held, parts, length))

    return run


def _mixed_array(*columns: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = _mixed(out * np.uint64(_BASE) + np.ascontiguousarray(c).view(np.uint64))
    return out


def _first_of_equals(anchor: np.ndarray, unit: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which units are the earliest of those equal to them, and which repeat one that stands elsewhere."""
    key = _mixed_array(anchor, unit)
    order = np.argsort(key)
    alike = key[order][1:] == key[order][:-1]
    several = np.append(False, alike) | np.append(alike, False) if len(order) else np.zeros(0, bool)
    single, order = order[~several], order[several]
    order = order[np.lexsort((start[order], doc[order], unit[order], anchor[order]))]
    head = np.ones(len(order), bool)
    a, u = anchor[order], unit[order]
    head[1:] = (a[1:] != a[:-1]) | (u[1:] != u[:-1])
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return np.append(single, order[head]), order[~head & later]


def _sizes_of(anchor: np.ndarray) -> np.ndarray:
    """For each of several units how many have its anchor."""
    _, of, size = np.unique(anchor, return_inverse=True, return_counts=True)
    return size[of]


def _collapsed(held: list[list[np.ndarray]], parts: int, length: int) -> list[tuple[int, int, int, bytes]]:
    """Of equal units of a task the first goes on; the others' windows repeat."""
    anchor, unit, doc, row, start, windows, *text = (np.concatenate(c) for c in zip(*held, strict=True))
    first, gone = _first_of_equals(anchor, unit, doc, start)
    loud = _sizes_of(anchor[first]) > LOUD_UNITS
    marks = np.unique(anchor[first[loud]])
    out = _blobs(marks.view(np.uint64) % np.uint64(parts), MARK, [marks])
    for kind, own in ((SORT, np.sort(first[~loud])), (HOT, np.sort(first[loud]))):
        part = (anchor[own].view(np.uint64) if kind == SORT else _mixed_array(anchor[own], unit[own])) % np.uint64(parts)
        out += _blobs(part, kind, [c[own] for c in (anchor, unit, doc, row, start, windows)], *[(t, _begin(windows, length)[own]) for t in text], length=length)
    gone = np.sort(gone)
    return out + _blobs(doc[gone].view(np.uint64) % np.uint64(parts), REPEATS, [c[gone] for c in (doc, row, start, windows)])


def _begin(windows: np.ndarray, length: int) -> np.ndarray:
    """Where each unit's text begins if they lie one after the other."""
    return np.cumsum(windows + length - 1) - (windows + length - 1)


MET = "doc_id long, row long, part int, kind int, n long, payload binary"


def _rows(kind: int, doc: np.ndarray, row: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """One row for each document, its numbers in 8-byte columns."""
    if not len(doc):
        return []
    order = np.lexsort((row, doc))
    new = np.flatnonzero(np.append(True, (doc[order][1:] != doc[order][:-1]) | (row[order][1:] != row[order][:-1])))
    columns = [c[order] for c in columns]
    ends = np.append(new[1:], len(order))
    return [(int(doc[order[s]]), int(row[order[s]]), 0, kind, int(e - s), b"".join(c[s:e].tobytes() for c in columns)) for s, e in zip(new.tolist(), ends.tolist(), strict=True)]


def _frame(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["doc_id", "row", "part", "kind", "n", "payload"])


def _meet(hot_units: int, length: int, again: bool, last: bool):
    """Units of some anchors from all tasks: which repeat, which are to be sorted, and which to be named anew."""

    def run(pdf):
        out = []
        held = {kind: list(zip(own["payload"], own["n"], strict=True)) for kind, own in pdf.groupby("kind")}
        for blob, n in held.get(REPEATS, []):
            doc, row, start, windows = _unpacked(blob, n, 4)
            out += _rows(REPEATS, doc, row, [start, windows])
        marks = [_unpacked(blob, n, 1)[0] for blob, n in held.get(MARK, [])]
        for kind in (SORT, HOT):
            if kind not in held:
                continue
            met = [_with_text(b, n, 6, length) if again else (_unpacked(b, n, 6), None) for b, n in held[kind]]
            anchor, unit, doc, row, start, windows = (np.concatenate(c) for c in zip(*[m[0] for m in met], strict=True))
            first, gone = _first_of_equals(anchor, unit, doc, start)
            out += _rows(REPEATS, doc[gone], row[gone], [start[gone], windows[gone]])
            units = _sizes_of(anchor[first])
            hot = np.full(len(first), kind == HOT)
            if kind == SORT:
                hot |= units > hot_units
                if marks:
                    hot |= np.isin(anchor[first], np.concatenate(marks))
            if last:
                hot[:] = False
            for to, own in ((SORT, first[~hot & (units > 1)]), (HOT, first[hot])):
                if not again:
                    out += _rows(to, doc[own], row[own], [anchor[own], start[own], windows[own]])
                elif len(own):
                    text = _taken(np.concatenate([m[1] for m in met]), _begin(windows, length)[own], windows[own] + length - 1)
                    out.append((0, 0, int(pdf["part"].iloc[0]), to, len(own), _text_blob([c[own] for c in (anchor, doc, row, start, windows)], text)))
        return _frame(out)

    return run


def _cut_out(parts: int, length: int):
    """The texts of the units that each document is asked for, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw = [t.encode() for t in batch.column(2).to_pylist()]
            base = np.cumsum([0, *[len(r) for r in raw[:-1]]])
            numbers = []
            for doc, row, at, asked in zip(ids, rows, base.tolist(), batch.column(3).to_pylist(), strict=True):
                for ask in asked:
                    anchor, start, windows = np.frombuffer(ask["payload"], np.int64).reshape(3, -1)
                    numbers.append(np.stack([anchor, np.full(len(start), doc), np.full(len(start), row), start, windows, start + at, np.full(len(start), ask["kind"])]))
            own = np.concatenate(numbers, axis=1)
            out = []
            for kind in (SORT, HOT):
                chosen = own[:, own[6] == kind]
                out += _blobs(_mixed_array(chosen[0]) % np.uint64(parts), kind, list(chosen[:5]), (np.frombuffer(b"".join(raw), np.uint8), chosen[5]), length)
            yield _blob_batch(out)

    return run


def _sorted_shard(length: int, symbols: int):
    def run(pdf):
        out, numbers, texts = [], [], []
        for n, payload in zip(pdf["n"], pdf["payload"], strict=True):
            own, text = _with_text(payload, n, 5, length)
            numbers.append(np.stack(own, axis=1))
            texts.append(text)
        own, text = np.concatenate(numbers), np.concatenate(texts)
        sizes = own[:, 4] + length - 1
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((own[:, 3], own[:, 1], own[:, 0]))
        found = [np.empty((0, 3), np.int64)]
        for chosen in _shares(own[order, 0], sizes[order], symbols):
            at = order[chosen]
            unit, shift = repeated_windows(_taken(text, begin[at], sizes[at]), own[at, 4], own[at, 1], own[at, 3], length)
            unit = at[unit]
            found.append(np.stack([own[unit, 1], own[unit, 2], own[unit, 3] + shift], axis=1))
        f = np.concatenate(found)
        f = f[np.lexsort((f[:, 2], f[:, 1], f[:, 0]))]
        if len(f):  # windows side by side are one run
            new = np.append(True, (f[1:, 0] != f[:-1, 0]) | (f[1:, 1] != f[:-1, 1]) | (f[1:, 2] > f[:-1, 2] + 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(f)) - 1
            out = _rows(REPEATS, f[first, 0], f[first, 1], [f[first, 2], f[last, 2] - f[first, 2] + 1])
        return _frame(out)

    return run


def _shares(anchor: np.ndarray, sizes: np.ndarray, symbols: int) -> Iterator[np.ndarray]:
    """Units, sorted by anchor and place, in shares of about ``symbols`` bytes; an anchor's units stay together."""
    begin = np.append(0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1)
    total = np.add.reduceat(sizes, begin)
    ends = np.append(begin[1:], len(anchor))
    start, weight = 0, 0
    for s, e, w in zip(begin.tolist(), ends.tolist(), total.tolist(), strict=True):
        if weight and weight + w > symbols:
            yield np.arange(start, s)
            start, weight = s, 0
        weight += w
    if weight:
        yield np.arange(start, e)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            kept, sizes, removed, spans = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                sizes.append(len(raw))
                if not found:
                    kept.append(raw)
                    removed.append(0)
                    spans.append(0)
                    continue
                runs = np.concatenate([np.frombuffer(p, np.int64).reshape(2, -1) for p in found], axis=1)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, runs[0], 1)
                np.add.at(edge, runs[0] + runs[1] + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in (sizes, removed, spans)]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, hot_units: int = 0, symbols: int = SHARD_SYMBOLS, part_text: int = PART_TEXT) -> DataFrame:
    """Every document without its repeated bytes: doc_id, kept (binary), n_bytes, n_removed, n_spans."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-total // part_text))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("row"), "text")

    def meet(found: DataFrame, anchor: int, again: bool) -> DataFrame:
        most = hot_units or max(2, symbols // (2 * length - anchor))
        met = found.repartitionById(parts, F.col("part")).groupBy("part").applyInPandas(_meet(most, length, again, anchor == length), MET)
        return saved(met, f"units-{anchor}")

    first, *more = levels(length)
    met = meet(arrow_map(keyed.select("id", "row", "text"), _find(parts, length, first, False), BLOB), first, False)
    asked = met.where(F.col("kind") != REPEATS).select(F.col("doc_id").alias("id"), "row", F.struct("kind", "payload").alias("ask"))
    asked = asked.repartition(parts, "id", "row").groupBy("id", "row").agg(F.collect_list("ask").alias("asked"))
    wanted = keyed.repartition(parts, "id", "row").join(asked.hint("shuffle_hash"), ["id", "row"]).select("id", "row", "text", "asked")
    units = arrow_map(wanted, _cut_out(parts, length), BLOB)
    repeats = met.where(F.col("kind") == REPEATS)
    if more and not met.where(F.col("kind") == HOT).isEmpty():
        units = saved(units, "texts")
        hot, units = units.where(F.col("kind") == HOT), units.where(F.col("kind") == SORT)
        for anchor in more:
            met = meet(arrow_map(hot.select("n", "payload"), _find(parts, length, anchor, True), BLOB), anchor, True)
            units = units.unionByName(met.where(F.col("kind") == SORT).select("part", "kind", "n", "payload"))
            repeats = repeats.unionByName(met.where(F.col("kind") == REPEATS))
            hot = met.where(F.col("kind") == HOT)
            if anchor == length or hot.isEmpty():
                break
    shards = units.repartitionById(parts, F.col("part")).groupBy("part").applyInPandas(_sorted_shard(length, symbols), MET)
    repeats = repeats.unionByName(shards).select(F.col("doc_id").alias("id"), "row", "payload")
    repeats = repeats.repartition(parts, "id", "row").groupBy("id", "row").agg(F.collect_list("payload").alias("found"))
    rows = keyed.repartition(parts, "id", "row").join(repeats.hint("shuffle_hash"), ["id", "row"], "left").select("doc_id", "text", "found")
    return arrow_map(rows, _cut(length), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
