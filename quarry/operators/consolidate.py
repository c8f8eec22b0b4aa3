"""Consolidation of generalisations: canonical form, judge, merge cascade, evidence, status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.canon import let
from quarry.operators.knowledge import K_MIN, identifying, support, support_tier

# Words that carry nothing in a canonical form.
FILLER = "a an the some any will they be been is are to that can proceed begin start started executed signed of and always consistently usually typically generally often tend tends every all".split()
# Words that stand for one concept ("" drops the word).
SYNONYMS = {
    "dpa": "signed_dpa", "dpas": "signed_dpa",
    "data": "", "processing": "", "agreement": "", "agreements": "",
    "enterprise": "segment_buyer", "procurement": "segment_buyer", "buyers": "segment_buyer", "buyer": "segment_buyer", "accounts": "segment_buyer", "account": "segment_buyer",
    "teams": "segment_buyer", "team": "segment_buyer", "customers": "segment_buyer", "customer": "segment_buyer", "clients": "segment_buyer",
    "security": "security_review", "review": "security_review", "assessment": "security_review", "assessments": "security_review",
    "require": "requires", "requires": "requires", "required": "requires", "requiring": "requires", "need": "requires", "needs": "requires", "require_before": "requires",
    "block": "blocks", "blocks": "blocks", "blocked": "blocks",
    "before": "before", "until": "before",
}
# Phrases that become one word, longer ones first.
PHRASES = [
    (r"\bdata\s+processing\s+agreement\b", "signed_dpa"),
    (r"\bsigned\s+dpa\b", "signed_dpa"),
    (r"\bbusiness\s+associate\s+agreement\b", "signed_baa"),
    (r"\bbaa\b", "signed_baa"),
    (r"\bsoc\s*2(?:\s+type\s+ii)?(?:\s+(?:report|attestation))?\b", "soc2_report"),
    (r"\b(?:third[- ]party\s+|independent\s+)?pen(?:etration)?[- ]test(?:\s+report)?\b", "pentest"),
    (r"\b(?:vendor\s+)?security\s+questionnaire\b", "security_questionnaire"),
    (r"\bsecurity\s+(?:review|assessment|evaluation|evaluations)\b", "security_review"),
    (r"\bsecurity\s+teams?\b", "segment_buyer"),
]
# Things that may be required, each one its own generalisation.
ARTIFACTS = ["pentest", "security_questionnaire", "signed_baa", "signed_dpa", "soc2_report"]

BUYER, GATE, NEEDS, BLOCKS, BEFORE = "segment_buyer", "security_review", "requires", "blocks", "before"


def _words(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _if(condition: Column, *words: str) -> Column:
    return F.when(condition, _words(words)).otherwise(_words([]))


def canonical_statement(statement: Column) -> Column:
    """One form for all wordings of a generalisation; different ones stay apart.

    Phrases and synonyms become single words and filler goes. What blocks A
    until B reads as requiring B before A. Statements of that family are put
    together by role: who, requires, what (sorted), before, gate; others as
    who, first verb, the rest sorted.
    """
    s = F.regexp_replace(F.regexp_replace(F.lower(statement), r"\([^)]*\)", " "), r"[^a-z0-9_\s]", " ")
    for pattern, word in PHRASES:
        s = F.regexp_replace(s, pattern, f" {word} ")
    return let(let(let(s, _turned), _concepts), _assembled)


def _turned(s: Column) -> Column:
    """What blocks A until B as requiring B before A."""
    at = F.instr(s, " until ")
    gated = F.regexp_replace(F.when(at > 0, F.substring_index(s, " until ", 1)).otherwise(s), r"\bblock\w*\b", " ")
    wanted = F.when(at > 0, F.substr(s, at + 7)).otherwise(F.lit(""))
    return F.when(s.rlike(r"\buntil\b") & s.rlike(r"\bblock"), F.concat(F.lit(" requires "), wanted, F.lit(" before "), gated)).otherwise(s)


def _concepts(s: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    mapped = F.transform(F.split(s, r"\s+"), lambda w: F.coalesce(F.try_element_at(known, w), w))
    return F.array_distinct(F.filter(mapped, lambda w: (w != "") & ~w.isin(*FILLER)))


def _assembled(words: Column) -> Column:
    has = lambda w: F.array_contains(words, w)
    role = has(BEFORE) & (has(NEEDS) | has(BLOCKS))
    what = F.array_sort(F.filter(words, lambda w: ~w.isin(BEFORE, NEEDS, BLOCKS, BUYER, GATE)))
    family = F.concat(_if(has(BUYER), BUYER), _words([NEEDS]), what, _if(has(GATE), BEFORE, GATE))
    verb = F.slice(F.filter(words, lambda w: w.isin(NEEDS, BLOCKS)), 1, 1)
    rest = F.array_sort(F.filter(words, lambda w: ~w.isin(NEEDS, BLOCKS, BUYER)))
    return F.array_join(F.when(role, family).otherwise(F.concat(_if(has(BUYER), BUYER), verb, rest)), " ")


def artifacts(canonical: Column) -> Column:
    return F.array_sort(F.array_intersect(F.split(canonical, " "), _words(ARTIFACTS)))


def judged(proposals: DataFrame, items: DataFrame) -> DataFrame:
    """id and merge_into, the first item (knowledge_id) that says the same: an equal canonical form, or equal artifacts.

    Two equi-joins with one row for each form and for each set of artifacts, so
    no pair is formed that the judge would turn down.
    """
    live = items.where(F.col("status").isin("candidate", "published"))
    form = live.where("canonical <> ''").groupBy("canonical").agg(F.min("knowledge_id").alias("by_form"))
    what = live.withColumn("what", artifacts(F.col("canonical"))).where(F.size("what") > 0).groupBy("what").agg(F.min("knowledge_id").alias("by_what"))
    rows = proposals.select("id", "canonical", artifacts(F.col("canonical")).alias("what")).join(form, "canonical", "left").join(what, "what", "left")
    return rows.select("id", F.coalesce(F.least("by_form", "by_what"), "by_form", "by_what").alias("merge_into"))


def cascade(proposals: DataFrame, items: DataFrame, lexicon: DataFrame, auto_merge: bool = True) -> DataFrame:
    """What becomes of each proposal: id, outcome, knowledge_id (of the item it went to, null for a new one).

    proposals: id, statement, canonical, merge_into; items: knowledge_id,
    statement, canonical, status, first_seen. In order: an item of equal form,
    oldest first; the judge's choice, if it is still live; a form that was
    rejected before; a statement that names someone is held back; an equal
    statement's twin; a new candidate.
    """
    form = F.nullif(F.trim("canonical"), F.lit(""))
    p = proposals.withColumn("form", form)
    i = items.withColumn("form", form)
    live = i.where(F.col("status").isin("candidate", "published"))
    exact = live.where("form IS NOT NULL").groupBy("form").agg(F.min_by("knowledge_id", F.struct("first_seen", "knowledge_id")).alias("exact"))
    target = live.select(F.col("knowledge_id").alias("merge_into")).withColumn("valid", F.lit(True))
    gone = i.where("status = 'rejected'")
    by_form = gone.where("form IS NOT NULL").groupBy("form").agg(F.min("knowledge_id").alias("rejected_form"))
    by_text = gone.groupBy("statement").agg(F.min("knowledge_id").alias("rejected_text"))
    open_ = i.where(F.col("status").isin("candidate", "eligible"))
    twin_form = open_.where("form IS NOT NULL").groupBy("form").agg(F.min("knowledge_id").alias("twin_form"))
    twin_text = open_.groupBy("statement").agg(F.min("knowledge_id").alias("twin_text"))
    named = identifying(proposals.select("id", "statement"), lexicon)
    rows = p.join(exact, "form", "left").join(target, "merge_into", "left").join(by_form, "form", "left").join(by_text, "statement", "left").join(twin_form, "form", "left").join(twin_text, "statement", "left").join(named, "id", "left")
    judge = F.when(F.lit(auto_merge) & F.col("valid"), F.col("merge_into"))
    rejected = F.coalesce("rejected_form", F.when(F.col("form").isNull(), F.col("rejected_text")))
    twin = F.least("twin_form", "twin_text")
    outcome = F.when(F.col("exact").isNotNull(), "canonical_exact").when(judge.isNotNull(), "judge").when(rejected.isNotNull(), "rejected_memory").when(F.col("term").isNotNull(), "quarantined").when(twin.isNotNull(), "accrued").otherwise("inserted")
    to = F.when(outcome != "quarantined", F.coalesce("exact", judge, rejected, twin))
    return rows.select("id", outcome.alias("outcome"), to.alias("knowledge_id"))


def merge_evidence(items: DataFrame, evidence: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, evidence) after added evidence; an episode counts once for each item.

    evidence, added: knowledge_id, episode_id, entity, writer, trust_tier.
    Touched items are counted anew; once seen, first-tier evidence stays.
    """
    new = added.dropDuplicates(["knowledge_id", "episode_id"]).join(evidence.select("knowledge_id", "episode_id"), ["knowledge_id", "episode_id"], "left_anti")
    after = evidence.unionByName(new.select(*evidence.columns))
    touched = added.select("knowledge_id").distinct()
    counts = support(after.join(touched, "knowledge_id", "left_semi")).select("knowledge_id", *[F.col(c).alias(f"now_{c}") for c in ("entities", "evidence", "writers", "has_tier1")])
    rows = items.join(counts, "knowledge_id", "left")
    now = {c: F.coalesce(f"now_{c}", c) for c in ("entities", "evidence", "writers")} | {"has_tier1": F.col("has_tier1") | F.coalesce("now_has_tier1", F.lit(False))}
    out = rows.select(*[now[c].alias(c) if c in now else F.col(c) for c in items.columns])
    return out.withColumn("tier", F.when(F.col("status") == "published", support_tier(F.col("entities")))), after


def decided(items: DataFrame, decisions: DataFrame, at: int) -> DataFrame:
    """Items (knowledge_id, status) after reviewers' decisions (knowledge_id, decision, reason).

    ``eligible`` takes candidates only, ``reject`` whatever is not yet rejected,
    invalidated or published; anything else changes nothing.
    """
    rows = items.join(decisions, "knowledge_id", "left")
    marks = (F.col("decision") == "eligible") & (F.col("status") == "candidate")
    drops = (F.col("decision") == "reject") & F.col("status").isin("candidate", "eligible", "quarantined")
    status = F.when(marks, "eligible").when(drops, "rejected").otherwise(F.col("status"))
    return rows.select(*[c for c in items.columns if c != "status"], status.alias("status"), F.when(drops, F.col("reason")).alias("reject_reason"), F.when(drops, F.lit(at).cast("long")).alias("rejected_at"))


def knowledge_chunk(items: DataFrame, at: int) -> DataFrame:
    """The chunk that a published item is read by: its statement, its own access, and a bucket of its support."""
    rows = items.where((F.col("status") == "published") & (F.col("entities") >= K_MIN))
    return rows.select(F.concat(F.lit("knowledge:"), "knowledge_id").alias("document_id"), F.lit(0).alias("seq"), F.col("statement").alias("content"), "visibility", F.lit("knowledge").alias("kind"), support_tier(F.col("entities")).alias("support_tier"), F.lit(at).cast("long").alias("valid_from"))
