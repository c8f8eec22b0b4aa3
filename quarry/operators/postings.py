"""BM25 over postings that are kept up to date and read in part.

A posting row holds a term's occurrences in one span of ids: the ids with their
counts and lengths, and ahead of them how many they are, the greatest count and
the smallest length. Those two bound every score in the span whatever the mean
length is, so a query first reads the bounds of its terms, scores the most
promising spans, and then reads only spans whose bound reaches the kth score
found. The result is that of scoring everything.

Upkeep is by segments with signs: changed chunks add rows of sign -1 for their
old text and +1 for the new one, and all counts (of a term, of the tenant, of a
posting) are sums with signs. ``compact`` merges them. Erasing takes rows out of
the files themselves: only files that hold postings of the erased chunks are
written anew, and nothing of them stays in any.

Scale: texts are shuffled by span, which takes less disk than their postings, so a
task has whole spans and writes each term of a span once. Files are dealt by
term within a task, so a common word is in many files; they are sorted by
term, so row groups without the query's terms are skipped. Erasing shuffles
no postings, compacting those of changed spans. A query shuffles postings of
its own terms alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from quarry.operators.scope import Scope, scoped_chunks
from quarry.session import kept
from quarry.sources.files import NAME, Files

# The usual parameters of BM25.
K1, B = 1.2, 0.75
#: Folders that terms are dealt to.
PARTS = 32
#: Words that one task puts in blocks, and the fewest for which there is another task.
TASK_WORDS, LEAST_WORDS = 8_000_000, 500_000
#: Ids of one span.
SPAN = 256
#: Spans that are scored first.
AHEAD = 16
#: Queries that are scored together, and blocks of them that one pass over the postings takes.
QUERY_BLOCK, PASS_BLOCKS = 1_000, 16

POSTINGS = "tenant string, term string, span long, sign int, n int, max_tf int, min_dl int, ids array<long>, tfs array<int>, dls array<int>"
STATS = "tenant string, n long, total long"
_BEST = StructType([StructField("q", IntegerType()), StructField("id", LongType()), StructField("score", DoubleType())])
#: How posting files are written: ids, which rise within a row, by their differences.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#ids.list.element": "false"}


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def terms_of(text: str) -> list[str]:
    return [t for t in dict.fromkeys(re.split("[^a-z0-9]+", text.lower())) if t]


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class Index:
    postings: Files
    stats: Files

    def numbers(self) -> DataFrame:
        """tenant, n chunks and total words."""
        return self.stats.read().groupBy("tenant").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(Files(spark, f"{folder}/postings", POSTINGS, PACKED), Files(spark, f"{folder}/stats", STATS))


#: Characters whose words are put in blocks at once.
FLUSH = 4 << 20
#: What postings of one term in one span are together.
BLOCK = ["tenant", "term", "span", "sign"]


def _span(ident: Column) -> Column:
    # towards zero, as div rounds
    return F.call_function("div", ident.cast("long"), F.lit(SPAN))


def _lowered(chunks: DataFrame) -> DataFrame:
    return chunks.select("tenant", F.col("id").cast("long").alias("id"), F.lower(F.coalesce("content", F.lit(""))).alias("s"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (tenant, id, s, sign, span) in order of span and id as posting rows, one for each term, span and sign."""
    word, size, last = re.compile("[a-z0-9]+"), 0, None
    texts: list[tuple] = []  # group, id, words and different words of each text
    groups, terms = defaultdict(), defaultdict()  # numbers in order of first sight
    groups.default_factory, terms.default_factory = groups.__len__, terms.__len__
    found, tfs = [], []
    for batch in batches:
        for tenant, ident, text, sign, span in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            # a span is never cut in two
            if size >= FLUSH and (span is None or span != last):
                yield _block(texts, list(groups), list(terms), found, tfs)
                size = 0
                for held in (texts, groups, terms, found, tfs):
                    held.clear()
            last = span
            words = word.findall(text)
            counts = Counter(words)
            texts.append((groups[tenant, span, sign], ident, len(words), len(counts)))
            found.extend(map(terms.__getitem__, counts))
            tfs.extend(counts.values())
            size += len(text)
    yield _block(texts, list(groups), list(terms), found, tfs)


def _block(texts: list[tuple], groups: list[tuple], terms: list[str], found: list[int], tfs: list[int]) -> pa.RecordBatch:
    """Posting rows of texts, by numbers of their groups (tenant, span, sign) and terms."""
    group, idents, words, sizes = zip(*texts, strict=True) if texts else [()] * 4
    sizes = np.array(sizes, np.int64)
    key = np.repeat(np.array(group, np.int64), sizes) * len(terms) + np.array(found, np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    ends = pa.array(np.append(starts, len(key)), pa.int32())
    line = pa.array(np.repeat(np.arange(len(texts)), sizes)[order])
    tf, dl = np.array(tfs, np.int32)[order], np.array(words, np.int32)[line.to_numpy()]
    of, term = np.divmod(key[starts], max(len(terms), 1))
    tenants, spans, signs = zip(*groups, strict=True) if groups else [()] * 3
    columns = {
        "tenant": pa.array(tenants, pa.string()).take(pa.array(of)),
        "term": pa.array(terms, pa.string()).take(pa.array(term)),
        "span": pa.array(spans, pa.int64()).take(pa.array(of)),
        "sign": pa.array(signs, pa.int32()).take(pa.array(of)),
        "n": pa.array(np.diff(np.append(starts, len(key))), pa.int32()),
        "max_tf": pa.array(np.maximum.reduceat(tf, starts) if len(key) else tf),
        "min_dl": pa.array(np.minimum.reduceat(dl, starts) if len(key) else dl),
        "ids": pa.ListArray.from_arrays(ends, pa.array(idents, pa.int64()).take(line)),
        "tfs": pa.ListArray.from_arrays(ends, pa.array(tf)),
        "dls": pa.ListArray.from_arrays(ends, pa.array(dl)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _tasks(spark: SparkSession, words: int) -> int:
    """Tasks for so many words: as many as run at once, and more where these would be too large."""
    return max(1, -(-words // TASK_WORDS), min(spark.sparkContext.defaultParallelism, words // LEAST_WORDS))


def _rows_of(grouped: GroupedData, held: Column, by: list[str]) -> DataFrame:
    """Posting rows of groups by term, span and sign; held: their postings as an array of (id, tf, dl)."""
    rows = grouped.agg(F.sort_array(held).alias("p"))
    return rows.select(*{c: 0 for c in [*by, *BLOCK]}, F.size("p").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.dl").alias("min_dl"), F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))


def _written(index: Index, rows: DataFrame, drop: list[str] = ()) -> None:
    dealt = rows.withColumn("part", _part(F.col("term")))
    index.postings.add(dealt.sortWithinPartitions("part", "tenant", "term", "span"), F.col("part"), drop)


def update(index: Index, before: DataFrame, after: DataFrame) -> Index:
    """The index after chunks changed: ``before`` are their former rows (tenant, id, content), ``after`` the present ones.

    A new chunk is in ``after`` alone, one that is retired in ``before`` alone.
    """
    texts = _lowered(before).withColumn("sign", F.lit(-1)).unionByName(_lowered(after).withColumn("sign", F.lit(1)))
    words = texts.select("tenant", "sign", F.regexp_count("s", F.lit("[a-z0-9]+")).cast("long").alias("dl"))
    sums = kept(words.groupBy("tenant").agg(F.sum("sign").cast("long").alias("n"), F.sum(F.col("sign") * F.col("dl")).alias("total"), F.sum("dl").alias("size")))
    index.stats.add(sums.select("tenant", "n", "total").coalesce(1))
    size = sums.agg(F.sum("size")).head()[0] or 0
    spans = texts.withColumn("span", _span(F.col("id"))).repartition(_tasks(texts.sparkSession, size), F.coalesce("span", F.xxhash64("s")))
    _written(index, spans.sortWithinPartitions("span", "id").mapInArrow(_listed, POSTINGS))
    return index


def build_index(chunks: DataFrame, folder: str) -> Index:
    """The index of chunks (tenant, id, content) below a folder."""
    return update(open_index(chunks.sparkSession, folder), chunks.limit(0), chunks)


def _postings(rows: DataFrame, *by: str) -> DataFrame:
    """Live postings (tenant, term, id, tf, dl) of posting rows: those whose signs do not cancel out.

    With ``by``, columns that follow from term and span, rows that lie together by these are not shuffled.
    """
    keys = ["tenant", "term", *[c for c in by if c not in ("tenant", "term")]]
    one = rows.select(*keys, "sign", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select(*keys, "sign", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
    summed = one.groupBy(*keys, "id").agg(F.sum("sign").alias("live"), F.sum(F.col("sign") * F.col("tf")).cast("int").alias("tf"), F.sum(F.col("sign") * F.col("dl")).cast("int").alias("dl"))
    return summed.where("live > 0").drop("live")


def _blocks(postings: DataFrame, by: list[str]) -> DataFrame:
    """Live postings (by, tenant, term, span, id, tf, dl) that lie together by ``by`` as rows of sign 1."""
    return _rows_of(postings.withColumn("sign", F.lit(1)).groupBy(*by, *[c for c in BLOCK if c not in by]), F.collect_list(F.struct("id", "tf", "dl")), by)


def _with_files(index: Index) -> DataFrame:
    """All posting rows with their file's name."""
    return index.postings.read().select("*", F.regexp_extract("_metadata.file_path", NAME, 1).alias("file"))


def _files_of(rows: DataFrame) -> list[str]:
    return sorted(r["file"] for r in rows.select("file").distinct().collect())


def compact(index: Index) -> None:
    """One row of sign 1 for every term and span, and one row of numbers for every tenant.

    One update writes each term of a span once for a sign, so only spans are merged
    that have rows of several or negative signs; files without any stay as they are.
    """
    on = ["tenant", "span"]
    rows = _with_files(index).withColumn("folder", F.xxhash64(F.substring_index("file", "/", 1)))
    found = rows.groupBy(*on).agg(F.min("sign").alias("sign"), F.min("folder").alias("least"), F.max("folder").alias("most"))
    # a row for the ids of a span: small beside the postings
    mixed = F.broadcast(kept(found.where("sign < 0 OR least <> most").select(*on)))
    same = [F.col("r.tenant").eqNullSafe(F.col("m.tenant")), F.col("r.span").eqNullSafe(F.col("m.span"))]
    among = lambda held, how: held.alias("r").join(mixed.alias("m"), same, how)
    touched = _files_of(among(rows.select(*on, "file"), "left_semi"))
    if touched:
        held = index.postings.read(touched)
        tasks = _tasks(held.sparkSession, int(index.numbers().agg(F.sum("total")).head()[0] or 0))
        merged = _blocks(_postings(among(held, "left_semi").repartition(tasks, "span"), "span"), ["span"])
        _written(index, among(held, "left_anti").unionByName(merged), touched)
    old = index.stats.names()
    index.stats.add(index.numbers().coalesce(1), drop=old)


def _place(ident: str) -> str:
    """SQL of an id's place in its span, from 0: span 0 has ids of both signs."""
    return f"({ident} - span * {SPAN} + {SPAN - 1})"


def _gone(ident: str) -> str:
    """SQL of whether an id is among the erased ones of its span."""
    return f"(bit_get(gone[CAST({_place(ident)} div 64 AS INT)], CAST({_place(ident)} % 64 AS INT)) = 1)"


def erase(index: Index, chunks: DataFrame) -> list[str]:
    """Takes chunks (tenant, id, and content as it was indexed last) out of the files; returns the files that were written anew.

    Rows lose the postings of erased chunks, of whatever text these were, so no
    sign of the chunk, of its words or of former texts of it is left there.
    Rows stay where they are: which ids go is sent to them, as bits of each span.
    """
    on = ["tenant", "span"]
    places = chunks.select("tenant", F.col("id").cast("long").alias("id"), _span(F.col("id")).alias("span")).selectExpr(*on, f"{_place('id')} AS place")
    bits = [F.bit_or(F.expr(f"IF(place div 64 = {word}, shiftleft(1L, CAST(place % 64 AS INT)), 0L)")) for word in range(2 * SPAN // 64)]
    gone = F.broadcast(kept(places.groupBy(*on).agg(F.array(*bits).alias("gone"))))
    touched = _files_of(_with_files(index).select(*on, "ids", "file").join(gone, on).where(f"exists(ids, x -> {_gone('x')})"))
    if touched:
        held = index.postings.read(touched).join(gone, on, "left").withColumn("p", F.arrays_zip("ids", "tfs", "dls"))
        left = held.withColumn("p", F.expr(f"IF(gone IS NULL, p, filter(p, q -> NOT {_gone('q.ids')}))")).where("size(p) > 0")
        fresh = {"n": F.size("p"), "max_tf": F.array_max("p.tfs"), "min_dl": F.array_min("p.dls"), "ids": F.col("p.ids"), "tfs": F.col("p.tfs"), "dls": F.col("p.dls")}
        _written(index, left.withColumns(fresh).drop("p", "gone"), touched)
    texts = _lowered(chunks)
    sums = texts.select("tenant", F.size(tokens(F.col("s"))).alias("dl")).groupBy("tenant").agg((-F.count("*")).alias("n"), (-F.sum("dl")).cast("long").alias("total"))
    index.stats.add(sums.coalesce(1))
    return touched


def _idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def _share(tf: Column, dl: Column) -> Column:
    """A term's share of the score: more with its count, less with the text's length."""
    length = F.coalesce(F.try_divide(dl, F.col("total") / F.col("n")), F.lit(1.0))
    return _idf(F.col("n"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))


def _with_numbers(rows: DataFrame, frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    # a row for each term of the query, and one row
    return rows.join(F.broadcast(frequencies), "term").crossJoin(F.broadcast(stats))


def bm25(index: Index, chunks: DataFrame, scope: Scope, query: str, k: int, ahead: int = AHEAD) -> DataFrame:
    """id, score of the k best scoped chunks that hold any term of the query.

    Document frequencies and the mean length are those of the tenant's whole
    index; the scope filters what is ranked.
    """
    spark = chunks.sparkSession
    terms = terms_of(query)
    if not terms:
        return spark.createDataFrame([], "id long, score double")
    parts = {r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_part(F.col("term"))).collect()}
    names = index.postings.names()
    own = index.postings.read(names, parts).where((F.col("tenant") == scope.tenant) & F.col("term").isin(*terms))
    stats = index.numbers().where(F.col("tenant") == scope.tenant).select("n", "total")
    counts = own.groupBy("term").agg(F.sum(F.col("sign") * F.col("n")).alias("df")).where("df > 0")
    frequencies = spark.createDataFrame([(r["term"], r["df"]) for r in counts.collect()], "term string, df long")  # a row a term
    heads = own.where("sign > 0").groupBy("term", "span").agg(F.max("max_tf").alias("tf"), F.min("min_dl").alias("dl"))
    bounds = _with_numbers(heads, frequencies, stats).groupBy("span").agg(F.sum(_share(F.col("tf"), F.col("dl"))).alias("most"))
    visible = scoped_chunks(chunks, scope).select("id")

    def scored(spans: DataFrame) -> DataFrame:
        # the spans are few, or as many as there are: joined as Spark sees fit
        held = _postings(own.join(spans, "span", "left_semi"))
        rows = _with_numbers(held, frequencies, stats).groupBy("id").agg(F.round(F.sum(_share(F.col("tf"), F.col("dl"))), 6).alias("score"))
        return rows.join(visible, "id", "left_semi").orderBy(F.desc("score"), "id").limit(k)

    first = scored(bounds.orderBy(F.desc("most"), "span").limit(ahead).select("span")).collect()  # k rows
    if len(first) < k:
        return scored(bounds.select("span"))
    return scored(bounds.where(F.col("most") >= first[-1]["score"] - 1e-6).select("span"))


def best_many(index: Index, chunks: DataFrame, scope: Scope, queries: DataFrame, k: int) -> DataFrame:
    """qid, id, score: k rows and more of each query (qid, text), the k best scoped chunks that hold a term of it among them.

    Postings of the queries' terms are shuffled by span, as they are in the files.
    A task adds up the scores of one span's ids after another, by a
    product of matrices for each block of queries, and gives its k best for each query.
    """
    spark, kind = chunks.sparkSession, queries.schema["qid"].dataType
    asked = defaultdict(set)
    for r in queries.select("qid", tokens(F.coalesce("text", F.lit(""))).alias("terms")).collect():  # the stated query set
        asked[r["qid"]].update(r["terms"])
    qids = [q for q, terms in asked.items() if terms]
    stats = index.numbers().where(F.col("tenant") == scope.tenant).head()
    out = spark.createDataFrame([], StructType([StructField("qid", kind), *_BEST.fields[1:]]))
    if stats is None:
        return out
    own = index.postings.read().where(F.col("tenant") == scope.tenant)
    seen = scoped_chunks(chunks, scope).select(_span(F.col("id")).alias("span"), F.col("id").cast("long").alias("id"))
    # ids that are seen come as rows without a term
    visible = seen.where("id IS NOT NULL").groupBy("span").agg(F.collect_set("id").alias("ids")).selectExpr("span", "-1 AS t", "0 AS sign", "ids", "array() AS tfs", "array() AS dls")
    for first in range(0, len(qids), QUERY_BLOCK * PASS_BLOCKS):
        taken = qids[first : first + QUERY_BLOCK * PASS_BLOCKS]
        terms = spark.createDataFrame([(t,) for t in sorted(set().union(*(asked[q] for q in taken)))], "term string")
        counts = own.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum(F.col("sign") * F.col("n")).alias("df")).where("df > 0").collect()  # a row a term
        number = {r["term"]: t for t, r in enumerate(counts)}
        if not number:
            continue
        idf = np.array([math.log(1.0 + (stats["n"] - r["df"] + 0.5) / (r["df"] + 0.5)) for r in counts])
        mean = stats["total"] / stats["n"] if stats["n"] else 0.0
        load = spark.sparkContext.broadcast((k, idf, mean, [[number[t] for t in sorted(asked[q]) if t in number] for q in taken]))
        numbers = F.broadcast(spark.createDataFrame(list(number.items()), "term string, t int"))
        blocks = own.join(numbers, "term").select("span", "t", "sign", "ids", "tfs", "dls").where("span IS NOT NULL").unionByName(visible)
        near = blocks.select("span", "t", "sign", F.transform("ids", lambda i: (i - F.col("span") * SPAN).cast("short")).alias("at"), "tfs", "dls").repartition(_tasks(spark, stats["total"]), "span")
        found = near.sortWithinPartitions("span", "t").mapInArrow(lambda batches, load=load: _best_of(batches, *load.value), _BEST)
        named = F.broadcast(spark.createDataFrame(list(enumerate(taken)), StructType([StructField("q", IntegerType()), StructField("qid", kind)])))
        out = out.unionByName(found.join(named, "q").select("qid", "id", "score"))
    return out


def _best_of(batches: Iterator[pa.RecordBatch], k: int, idf: np.ndarray, mean: float, asked: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """q, id, score of the k best for each query, from rows (span, t, sign, at, tfs, dls) in order of span, those of seen ids first."""
    best = [(np.empty(0), np.empty(0, np.int64)) for _ in asked]

    def score(span: int, rows: list[tuple]) -> None:
        seen = np.concatenate([r[2] for r in rows if r[0] < 0] or [np.empty(0, np.int64)])
        rows = [r for r in rows if r[0] >= 0]
        if not len(seen) or not rows:
            return
        own, line = np.unique([r[0] for r in rows], return_inverse=True)
        sizes = [len(r[2]) for r in rows]
        where = np.repeat(line, sizes), np.concatenate([r[2] for r in rows]) + SPAN - 1
        sign = np.repeat([r[1] for r in rows], sizes)
        live, tf, dl = (np.zeros((len(own), 2 * SPAN)) for _ in range(3))
        for held, values in ((live, sign), (tf, sign * np.concatenate([r[3] for r in rows])), (dl, sign * np.concatenate([r[4] for r in rows]))):
            np.add.at(held, where, values)
        seen = np.sort(seen)
        live, tf, dl = (x[:, seen + SPAN - 1] for x in (live, tf, dl))
        # postings whose signs cancel out have no share
        length = dl / mean if mean else np.ones_like(dl)
        with np.errstate(divide="ignore", invalid="ignore"):
            shares = np.where(live > 0, idf[own][:, None] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length)), 0.0)
        place = {t: i for i, t in enumerate(own.tolist())}
        for first in range(0, len(asked), QUERY_BLOCK):
            block = [[place[t] for t in terms if t in place] for terms in asked[first : first + QUERY_BLOCK]]
            weights = np.zeros((len(block), len(own)))
            for q, terms in enumerate(block):
                weights[q, terms] = 1.0
            scores = weights @ shares
            for q in np.flatnonzero(scores.any(axis=1)).tolist():
                use = scores[q] > 0
                s, i = np.append(best[first + q][0], np.round(scores[q, use], 6)), np.append(best[first + q][1], span * SPAN + seen[use])
                top = np.lexsort((i, -s))[:k]
                best[first + q] = s[top], i[top]

    at, rows = None, []
    for batch in batches:
        spans, ts, signs = (batch.column(c).to_numpy() for c in range(3))
        lists = []
        for c in range(3, 6):
            column = batch.column(c)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy().astype(np.int64)
            lists.append([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        for span, *row in zip(spans.tolist(), ts.tolist(), signs.tolist(), *lists, strict=True):
            if span != at:
                score(at, rows)
                at, rows = span, []
            rows.append(tuple(row))
    score(at, rows)
    sizes = [len(i) for _, i in best]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["q", "id", "score"])
