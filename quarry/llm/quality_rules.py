"""Quality rules with risk-controlled thresholds.

Every rule rejects documents whose value is over a cutoff. Cutoffs are not
set by hand: labelled good documents, held out for this, bound how often a
set of cutoffs rejects wrongly. Per stratum the sets form one chain from the
most lenient on, each tightening one rule by one cutoff. The chain's order is
taken from all other documents of the stratum alone (bad ones and those
without a label): next comes the step that adds most bad documents for each
other one. Along the chain a set is certified if the exact (Clopper-Pearson)
upper bound of its false-rejection rate, at confidence 1 - delta / strata, is
at most alpha, and testing stops at the first that is not: a fixed sequence
needs no further correction, and strata are corrected by Bonferroni. So with
probability 1 - delta all rules together reject at most a share alpha of the
good documents of every stratum. Of the certified sets that one is taken that
rejects most bad documents, each falsely rejected one counting ``COST`` times.

Only strata with good documents enough to certify anything are tested, and
only they count as strata; how many labels there are says nothing about the
documents' values. In the others just the base rules reject.

Scale: texts are read once and become a row of numbers, which is written;
labels meet those numbers in one join and shrink to counts by stratum, label
and the number of cutoffs that each rule's value is over (52,650 combinations
at most) before anything reaches the driver, for tested strata only.

Cases: a null or empty text has no words and fails the base rules; very long
texts are read whole; a null stratum is one of its own; null labels and those
of missing documents are passed over, of several for one document the smallest
counts; rows that repeat count each; ties on a cutoff are not over it; other
columns, whatever their names, are not read; a table without rows gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, blocks, saved
from quarry.session import table

ALPHA, DELTA, COST = 0.02, 0.05, 5.0
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\x0c\r"

#: Each rule's value and its cutoffs, from the most lenient on.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("try_divide(n_symbols, n_words)", [2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "dup_lines": ("try_divide(n_dup_lines, n_lines)", [0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "repeats": ("try_divide(n_repeat_words, n_words)", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "capitals": ("try_divide(n_upper, word_chars)", [0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "marks": ("try_divide(n_marks, n_words)", [2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1]),
}

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def measures(text: str | None) -> tuple[int, ...]:
    """The numbers named in STATS, of the whole text."""
    text = text or ""
    words = text.encode().split()  # splits bytes at 20 and 09 to 0D
    seen: set[str] = set()
    lines = repeated = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            if line in seen:
                repeated += 1
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    in_repeats = 0
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        upto = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if count[w] > 1:
                in_repeats += i + 3 - max(upto, i)
                upto = i + 3
    upper = sum(map(str.isupper, text)) if text.upper() != text.lower() else 0
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), repeated, in_repeats, lines, upper, text.count("!") + text.count("?")


def stats(docs: DataFrame, stratum: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            columns = zip(*map(measures, batch.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "stratum", *STATS])

    return arrow_map(docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text"), run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in STATS))


def upper_bound(k: int, n: int, confidence: float) -> float:
    """The exact upper limit of a rate of which k in n were seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    for _ in range(60):
        p = (low + high) / 2
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)] if 0 < p < 1 else [0.0]
        top = max(terms)
        if top + math.log(sum(math.exp(t - top) for t in terms)) > math.log1p(-confidence):
            low = p
        else:
            high = p
    return high


Levels = tuple[int, ...]  # for each rule how many of its cutoffs a value is over, or how many are in use


def rejected(levels: Levels, state: Levels) -> list[bool]:
    """Which rules reject a document whose values are over ``levels`` cutoffs when the first ``state`` are in use."""
    return [over + used > len(cutoffs) for over, used, (_, cutoffs) in zip(levels, state, RULES.values(), strict=True)]


def chain(bad: Mapping[Levels, int], others: Mapping[Levels, int]) -> list[Levels]:
    """Sets of cutoffs, each tightening one rule by one: next the step that adds most bad documents for each other one."""
    state, out = (0,) * len(RULES), []
    bad, others = dict(bad), dict(others)
    sizes = [len(cutoffs) for _, cutoffs in RULES.values()]
    while True:
        open_rules = [r for r in range(len(sizes)) if state[r] < sizes[r]]
        if not open_rules:
            return out
        worth = {}
        for r in open_rules:
            new = sizes[r] - state[r]  # values over this many cutoffs are rejected by the step
            worth[r] = (sum(c for v, c in bad.items() if v[r] >= new) + 0.5) / (sum(c for v, c in others.items() if v[r] >= new) + 1)
        best = max(open_rules, key=lambda r: (worth[r], -r))
        new = sizes[best] - state[best]
        bad, others = ({v: c for v, c in counts.items() if v[best] < new} for counts in (bad, others))
        state = tuple(n + (r == best) for r, n in enumerate(state))
        out.append(state)


def choose(states: list[Levels], good: Mapping[Levels, int], bad: Mapping[Levels, int], alpha: float, confidence: float) -> Levels | None:
    """The set of cutoffs to use, of those that the good documents certify."""
    n, best, at = sum(good.values()), 0.0, None
    if not n:
        return None
    for state in states:
        wrong, right = (sum(c for v, c in counts.items() if any(rejected(v, state))) for counts in (good, bad))
        if wrong > alpha * n or upper_bound(wrong, n, confidence) > alpha:
            break
        if right - COST * wrong > best:
            best, at = right - COST * wrong, state
    return at


def needed(alpha: float, delta: float, strata: int) -> int:
    """Good documents without which nothing is certified in one of several strata."""
    return math.ceil(math.log(delta / strata) / math.log1p(-alpha))


def tested(good: Mapping[str | None, int], alpha: float, delta: float) -> list[str | None]:
    """As many strata as have good documents enough for so many to be tested."""
    order = sorted(good, key=lambda s: (-good[s], s is not None, s or ""))
    while order and good[order[-1]] < needed(alpha, delta, len(order)):
        order.pop()
    return order


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def certified(numbers: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str | None, str], float]:
    """Cutoffs by (stratum, rule). Documents that fail the base rules teach nothing about the others."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    over = lambda name: sum((F.coalesce(F.expr(RULES[name][0]) > F.lit(c), F.lit(False)).cast("int") for c in RULES[name][1]), F.lit(0))
    known = numbers.where(~base_failed()).join(marks, "doc_id", "left").select("stratum", "quality", *[over(r).alias(f"over_{r}") for r in RULES])
    counts = saved(known.groupBy("stratum", "quality", *[f"over_{r}" for r in RULES]).count(), "levels")
    enough = counts.where("quality = 1").groupBy("stratum").agg(F.sum("count").alias("n")).where(F.col("n") >= needed(alpha, delta, 1))
    strata = tested({r["stratum"]: r["n"] for r in enough.collect()}, alpha, delta)
    held: dict[str | None, list[Counter]] = {s: [Counter(), Counter(), Counter()] for s in strata}  # good, bad, without a label
    for r in counts.join(enough.select("stratum"), counts["stratum"].eqNullSafe(enough["stratum"]), "left_semi").collect():
        if r["stratum"] in held:
            held[r["stratum"]][2 if r["quality"] is None else 0 if r["quality"] == 1 else 1][tuple(r[f"over_{k}"] for k in RULES)] += r["count"]
    out = {}
    for stratum, (good, bad, unknown) in held.items():
        state = choose(chain(bad, unknown), good, bad, alpha, 1 - delta / len(strata))
        for used, (rule, (_, cutoffs)) in zip(state or (), RULES.items(), strict=False):
            if used:
                out[stratum, rule] = cutoffs[used - 1]
    return out


def screened(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every document's numbers, base_failed, rejected_by (names of rules) and kept."""
    spark = docs.sparkSession
    numbers = saved(stats(docs, stratum), "stats")
    cutoffs = certified(numbers, labels, alpha, delta)
    schema = "s string, " + ", ".join(f"cut_{r} double" for r in RULES)
    # one row for each stratum with a certified cutoff: at most labelled documents / needed
    wide = spark.createDataFrame([(s, *[cutoffs.get((s, r)) for r in RULES]) for s in dict.fromkeys(s for s, _ in cutoffs)], schema)
    joined = numbers.join(wide, numbers["stratum"].eqNullSafe(wide["s"]), "left")
    by = F.array_compact(F.array(*[F.when(F.expr(RULES[r][0]) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    out = joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", by)
    return out.select("doc_id", "stratum", *STATS, "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screened(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return rows.select("doc_id", *STATS[:5], "base_failed", "kept", "stratum", "rejected_by")
