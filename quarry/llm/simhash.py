"""SimHash near-duplicates, linked by pigeonring filtering.

A text's fingerprint has a bit set where more than half of its shingles'
hashes have it set. Fingerprints link where at most ``budget`` bits differ.

Search: the 64 bits are a ring of m = 2 * budget + 1 segments. If at most
``budget`` bits differ in all, then from some segment on every chain of l
consecutive segments differs in at most l * budget / m bits. For this m the
first two segments of that chain may not differ at all, so each
fingerprint is filed under the m pairs of adjacent segments (25 bits and
more for a budget of 2), and only fingerprints filed together are compared:
first by the chain condition, segment by segment, then in full.

Skew: equal fingerprints are one row before anything is filed, so a group of
copies weighs as one. Where more than ``crowd`` different fingerprints share
a file, pairs are not formed: two fingerprints of that file differ in at most
2 bits just when some fingerprint is within 1 bit of both, so each member is
filed once more under itself and everything 1 bit away (in the bits left
open), and links to the smallest member there. For budgets over 2 the members
of a crowded file are compared block against block and only what links is
kept. No pair of different fingerprints within the budget is lost either way.

Wider similarity. Fingerprints of two texts that share 0.8 of their shingles
differ in some 10 of 64 bits, which no exact search over single fingerprints
can narrow down. ``near_copies`` therefore takes fingerprints as candidates
only and decides by the similarity itself. Each text also has ``SAMPLES``
fingerprints of small samples of its shingles (the four with the smallest
hashes under a function of each sample). Texts that agree in one are
candidates: at a similarity of 0.8 all but some 0.5 % of pairs are, unrelated
texts never; so are texts whose fingerprints differ in at most ``budget``
bits. Candidates that hang together meet, each different shingle set once, and
link where the exact Jaccard similarity of their shingle sets is
``SIMILARITY`` or more. A task holds ``BLOCK_SETS`` sets or so: larger groups
are settled block by block (see ``_crowds``), and every component that all
pairs over the similarity make is found either way.

Cases: a null or empty text, or one of white space, has fingerprint zero and
links like any other; with fewer words than the shingle the whole sequence is
one shingle; repeated rows are copies; a null doc_id takes no part in naming
a component, whose id is null only if it has no other; other columns are not
read; a table without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, blocks, saved, with_values
from quarry.llm.components import components
from quarry.session import table

SHINGLE, BUDGET, SEED = 3, 2, 42
#: Different fingerprints in one file that are compared pair by pair.
CROWD = 64

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """All runs of k words, space-joined, repeats included."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False)))


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    own = shingles(words_of(text), k)
    if not own:
        return 0
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, seed) for s in own]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big")


#: Samples of each text, and shingles in each.
SAMPLES, SAMPLE_SIZE = 10, 4
#: Least Jaccard similarity of near copies, as a fraction of whole numbers.
SIMILARITY = (4, 5)


def hashes(text: str | None, k: int, seed: int = SEED) -> np.ndarray:
    """The text's set of shingles as sorted hashes."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, seed) for s in shingles(words_of(text), k)], np.uint64))


def set_id(h: np.ndarray) -> int:
    """A number for a set of shingles; 0 for the empty one."""
    return xxhash.xxh64_intdigest(h.tobytes(), SAMPLES) if len(h) else 0


def sample_fingerprints(h: np.ndarray) -> list[int]:
    """A number for each sample of a set of shingles; none for the empty one."""
    if not len(h):
        return []
    out = []
    with np.errstate(over="ignore"):
        for r in range(SAMPLES):
            x = (h ^ np.uint64(r * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            least = np.sort(np.partition(x, SAMPLE_SIZE - 1)[:SAMPLE_SIZE]) if len(x) > SAMPLE_SIZE else np.sort(x)
            out.append(xxhash.xxh64_intdigest(least.tobytes(), r))
    return out


def sampled_fingerprints(docs: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """doc_id, fp, own (a number for the set of shingles) and samples, the samples' fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            fps, owns, samples = [], [], []
            for t in batch.column(1).to_pylist():
                h = hashes(t, k, seed)
                fps.append(fingerprint(t, k, seed))
                owns.append(set_id(h))
                samples.append(np.array(sample_fingerprints(h), np.uint64).view(np.int64))
            signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(fps), signed(owns), pa.array(samples, pa.list_(pa.int64()))], names=["doc_id", "fp", "own", "samples"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp long, own long, samples array<long>")


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            fp = np.array([fingerprint(t, k, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def ring(budget: int) -> list[np.uint64]:
    """Masks of the ring's segments, of sizes as even as can be."""
    m = 2 * budget + 1
    edges = [round(64 * i / m) for i in range(m + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:], strict=False)]


def bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chained(x: np.ndarray, start: int, masks: list[np.uint64], budget: int) -> np.ndarray:
    """Which differences x pass: every chain from segment ``start`` keeps to its share of the budget."""
    m, total, alive = len(masks), np.zeros(len(x), np.int64), np.arange(len(x))
    for length in range(1, m + 1):
        total = total + bits(x[alive] & masks[(start + length - 1) % m])
        ok = total * m <= length * budget
        alive, total = alive[ok], total[ok]
        if not len(alive):
            break
    return alive


def _pairs(fps: np.ndarray, start: int, masks: list[np.uint64], budget: int) -> list[np.ndarray]:
    i, j = np.triu_indices(len(fps), 1)
    x = fps[i] ^ fps[j]
    ok = chained(x, start, masks, budget)
    return [np.stack([fps[i[ok]], fps[j[ok]]], axis=1)]


def _crowded(fps: np.ndarray, start: int, masks: list[np.uint64], budget: int, crowd: int) -> list[np.ndarray]:
    """Links that connect all pairs within the budget in one crowded file, without forming its pairs.

    Up to a budget of 2, each member is filed under all numbers within 1 bit of
    it and links to the smallest member of each such file. Over 2, blocks of
    members are compared against blocks, in memory of ``crowd`` rows squared.
    """
    out: list[np.ndarray] = []
    if budget <= 2:
        fixed = masks[start] | masks[(start + 1) % len(masks)]
        steps = [np.uint64(0), *[np.uint64(1 << b) for b in range(64) if not int(fixed) >> b & 1]]
        steps = steps if budget == 2 else steps[1:] + steps[:1]
        if budget == 1:  # members next to each other directly
            known = np.sort(fps)
            for s in steps[:-1]:
                at = np.minimum(np.searchsorted(known, fps ^ s), len(known) - 1)
                hit = known[at] == fps ^ s
                out.append(np.stack([fps[hit], known[at[hit]]], axis=1))
            return out
        middle = np.concatenate([fps ^ s for s in steps])
        who = np.tile(fps, len(steps))
        order = np.lexsort((who, middle))
        middle, who = middle[order], who[order]
        first = np.ones(len(middle), bool)
        first[1:] = middle[1:] != middle[:-1]
        head = who[np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))]
        apart = head != who
        return [np.unique(np.stack([head[apart], who[apart]], axis=1), axis=0)]
    for a in range(0, len(fps), crowd):
        for b in range(a, len(fps), crowd):
            x = fps[a : a + crowd, None] ^ fps[None, b : b + crowd]
            i, j = np.nonzero(bits(x) <= budget)
            apart = i + a < j + b
            out.append(np.stack([fps[i[apart] + a], fps[j[apart] + b]], axis=1))
    return out


def links(prints: DataFrame, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, distinct), connecting all within the budget."""
    masks = ring(budget)
    if budget == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    files = [F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(int(np.uint64(masks[s] | masks[(s + 1) % len(masks)]).astype(np.int64)))).alias("key")) for s in range(len(masks))]
    filed = prints.select("fp", F.explode(F.array(*files)).alias("f")).select("fp", "f.start", "f.key")
    members = filed.groupBy("start", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((0, 2), np.uint64)]
            ends = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy().view(np.uint64)
            for k, start in enumerate(batch.column(0).to_pylist()):
                fps = flat[ends[k] : ends[k + 1]]
                found += _pairs(fps, start, masks, budget) if len(fps) <= crowd else _crowded(np.sort(fps), start, masks, budget, 2048)
            pair = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return arrow_map(members.select("start", "fps"), run, "a long, b long")


def candidates(prints: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) between different shingle sets (prints: fp, own, samples) that connect all which share
    a sample or whose fingerprints differ in at most ``budget`` bits: each to the smallest it meets."""
    filed = prints.select("own", F.posexplode("samples").alias("r", "key")).unionByName(prints.select("own", F.lit(-1).alias("r"), F.col("fp").alias("key")))
    least = filed.groupBy("r", "key").agg(F.min("own").alias("b"), F.max("own").alias("most")).where("b <> most").select("r", "key", "b")
    stars = filed.join(least, ["r", "key"]).where("own <> b").select(F.col("own").alias("a"), "b")
    first = saved(prints.groupBy("fp").agg(F.min("own").alias("own")), "fingerprints")
    end = lambda c: first.select(F.col("fp").alias(c), F.col("own").alias(f"{c}_own"))
    near = links(first.select("fp"), budget).join(end("a"), "a").join(end("b"), "b").select(F.col("a_own").alias("a"), F.col("b_own").alias("b"))
    return stars.unionByName(near)


def alike(sets: list[np.ndarray], least: tuple[int, int] = SIMILARITY) -> list[int]:
    """For each of several sorted sets the place of the first one of its component, where pairs with a Jaccard
    similarity of ``least`` or more are linked.

    Every linked set is a seed once, and is compared with the sets still left
    that share one of its rarest elements: of n elements, a pair over the
    similarity of t shares one among the n - ceil(t n) + 1 rarest of both.
    """
    top, bottom = least
    n = len(sets)
    of = list(range(n))
    sizes = np.array([len(x) for x in sets], np.int64)
    if n < 2 or not sizes.sum():
        return of
    ends = np.append(0, np.cumsum(sizes))
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    flat = rank[ids]  # elements by rarity, 0 the rarest
    rare = [np.sort(flat[ends[i] : ends[i + 1]])[: sizes[i] - -(-top * sizes[i] // bottom) + 1] for i in range(n)]
    held = np.concatenate(rare)
    who = np.repeat(np.arange(n), [len(x) for x in rare])
    order = np.argsort(held, kind="stable")
    held, who = held[order], who[order]
    left = np.ones(n, bool)
    mark = np.zeros(len(counts), bool)
    remaining = n
    for start in range(n):
        if not left[start]:
            continue
        left[start], remaining, seeds = False, remaining - 1, [start]
        while seeds and remaining:
            s = seeds.pop()
            met = [who[a:b] for a, b in zip(np.searchsorted(held, rare[s]), np.searchsorted(held, rare[s], side="right"), strict=True)]
            near = np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)
            near = near[left[near]]
            near = near[(bottom * sizes[near] >= top * sizes[s]) & (bottom * sizes[s] >= top * sizes[near])]
            if not len(near):
                continue
            mark[flat[ends[s] : ends[s + 1]]] = True
            for j in near.tolist():
                both = int(np.count_nonzero(mark[flat[ends[j] : ends[j + 1]]]))
                if bottom * both >= top * (sizes[s] + sizes[j] - both):
                    of[j], left[j], remaining = start, False, remaining - 1
                    seeds.append(j)
            mark[flat[ends[s] : ends[s + 1]]] = False
    return of


def across(queries: list[tuple[int, np.ndarray]], members: list[tuple[int, np.ndarray]], least: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Links (label, label) between different labels: of each pair of a query and a member (label, sorted set) over the
    similarity. Two sets over it share one of the first n - ceil(t n) + 1 of their elements, in any fixed order.
    """
    top, bottom = least
    first = lambda x: x[: len(x) - -(-top * len(x) // bottom) + 1]
    heads = [first(x) for _, x in members]
    held = np.concatenate(heads)
    who = np.repeat(np.arange(len(members)), [len(x) for x in heads])
    order = np.argsort(held, kind="stable")
    held, who = held[order], who[order]
    found: set[tuple[int, int]] = set()
    for label, x in queries:
        own = first(x)
        met = [who[a:b] for a, b in zip(np.searchsorted(held, own), np.searchsorted(held, own, side="right"), strict=True)]
        for g in np.unique(np.concatenate(met)).tolist() if met else []:
            other, y = members[g]
            pair = (min(label, other), max(label, other))
            if label == other or pair in found or bottom * len(x) < top * len(y) or bottom * len(y) < top * len(x):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if bottom * both >= top * (len(x) + len(y) - both):
                found.add(pair)
    return sorted(found)


#: Sets of shingles that meet in one task.
BLOCK_SETS = 512


def _each(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each group, rows being sorted by their first columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _alike_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sets (root, block, own, held) of one block: own and label, the smallest own of its component there."""
    for rows in _each(batches, 2):
        owns = [r[2] for r in rows]
        of = alike([np.frombuffer(r[3], np.uint64) for r in rows])
        least: dict[int, int] = {}
        for own, at in zip(owns, of, strict=True):
            least[at] = min(own, least.get(at, own))
        yield pa.RecordBatch.from_arrays([pa.array(owns, pa.int64()), pa.array([least[at] for at in of], pa.int64())], names=["own", "label"])


def _across_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (root, block, part, asks, label, held): links between labels of those that ask and the others."""
    for rows in _each(batches, 3):
        sides = [[(r[4], np.frombuffer(r[5], np.uint64)) for r in rows if r[3] == asks] for asks in (True, False)]
        if all(sides):
            pair = np.array(across(*sides), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def _dealt(members: DataFrame, size: int) -> DataFrame:
    """Adds blocks, how many blocks of about ``size`` a root's members fill, and block, each member's own."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    values = sizes.select("root", "n", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    return with_values(members, values, "root", members.count()).withColumn("block", F.pmod(F.xxhash64("own"), F.col("blocks")).cast("int"))


def _met(sets: DataFrame) -> DataFrame:
    rows = sets.select("root", "block", "own", "held").repartition("root", "block").sortWithinPartitions("root", "block", "own")
    return arrow_map(rows, _alike_within, "own long, label long")


def _crowds(sets: DataFrame, size: int) -> DataFrame:
    """own and label of roots with several blocks (sets: root, own, held, blocks, block; a written table).

    Blocks are settled each on its own, then the first sets of their components
    among one another in the same way, until they fit one block. That leaves
    nearly all of a large group of copies in one component. What is not in the
    largest of its root is then held against every set of the root, block by
    block, so no link is lost.
    """
    level, links = sets, None
    while True:
        out = saved(_met(level), "settled")
        own = out.where("own <> label").select(F.col("own").alias("a"), F.col("label").alias("b"))
        links = own if links is None else links.unionByName(own)
        firsts = out.where("own = label").select("own")
        n, before = firsts.count(), out.count()
        if level.where("blocks > 1").isEmpty() or n == before:
            break
        numbers = saved(level.select("root", "own").join(firsts, "own", "left_semi"), "firsts")
        level = saved(sets.select("root", "own", "held").join(_dealt(numbers, size).drop("root"), "own"), "level")
    label = lambda found: sets.select("root", "own").join(components(found).select(F.col("node").alias("own"), F.col("root").alias("label")), "own", "left").select("root", "own", F.coalesce("label", "own").alias("label"))
    labels = saved(label(links), "labels")
    parts = labels.groupBy("root", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("labels"))
    split = saved(largest.where("labels > 1").select("root", "largest"), "split")
    if split.isEmpty():
        return labels.select("own", "label")
    total = split.count()
    known = with_values(labels.join(split.select("root"), "root", "left_semi"), split.withColumn("n", F.lit(total + 1)), "root", total)
    rows = sets.select("own", "held", "block", "blocks").join(known, "own")
    asks = rows.where("label <> largest").withColumn("part", F.pmod(F.xxhash64("own", "label"), F.col("blocks")).cast("int"))
    asking = asks.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", F.lit(True).alias("asks"), "label", "held")
    asked = rows.select("root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(False).alias("asks"), "label", "held")
    both = asking.unionByName(asked).repartition("root", "block", "part").sortWithinPartitions("root", "block", "part")
    more = saved(arrow_map(both, _across_within, "a long, b long"), "across")
    return label(links.unionByName(more)).select("own", "label")


def verified(docs: DataFrame, prints: DataFrame, roots: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """own and group, the smallest own of its component, for the shingle sets among candidates (roots: node, root)."""
    members = saved(_dealt(saved(roots.select(F.col("node").alias("own"), "root"), "roots"), BLOCK_SETS), "candidates")
    # one document for each set; a null id stands for all that have none
    ids = prints.join(members, "own", "left_semi").groupBy("own").agg(F.min("doc_id").alias("rep")).select("rep").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = [hashes(t, k, seed) for t in batch.column(0).to_pylist()]
            owns = np.array([set_id(h) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(owns), pa.array([h.tobytes() for h in sets], pa.binary())], names=["own", "held"])

    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["rep"]), "left_semi").select("text")
    sets = arrow_map(texts, cut, "own long, held binary").join(members, "own").dropDuplicates(["own"])
    if members.where("blocks > 1").isEmpty():
        return _met(sets).withColumnRenamed("label", "group")
    sets = saved(sets, "candidate-sets")
    found = _met(sets.where("blocks = 1")).unionByName(_crowds(saved(sets.where("blocks > 1"), "crowds"), BLOCK_SETS))
    return found.withColumnRenamed("label", "group")


def near_copies(docs: DataFrame, k: int = 5, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp and component_id: texts link where their sets of k-word shingles are alike by SIMILARITY or more."""
    prints = saved(sampled_fingerprints(docs, k), "prints")
    different = prints.select("fp", "own", "samples").distinct()
    found = verified(docs, prints, components(candidates(different, budget)), k)
    sets = saved(prints.groupBy("own").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).join(found, "own", "left").select("own", "n", "least", F.coalesce("group", "own").alias("group")), "sets")
    groups = sets.groupBy("group").agg(F.min("least").alias("component_id"))
    of = saved(sets.join(groups, "group").select("own", "n", "component_id"), "groups")
    return with_values(prints.select("doc_id", "fp", "own"), of, "own", prints.count()).select("doc_id", "fp", "component_id")


def grouped(prints: DataFrame, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """Adds component_id to documents' fingerprints (doc_id, fp; a written table)."""
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprints")
    roots = components(links(distinct.select("fp"), budget, crowd))
    linked = roots.join(distinct.select(F.col("fp").alias("node"), "first"), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = linked.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    # only fingerprints with links need the join by root; the rest are their own component
    of = saved(distinct.join(of, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "components")
    return with_values(prints, of, "fp", prints.count())


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = saved(fingerprints(table(spark, sf_dir, "documents")), "prints")
    return grouped(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
