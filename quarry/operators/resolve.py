"""Entity resolution: evidence, the fold into canonical entities, review, mentions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import components, kept

# Methods that link on their own, and kinds of keys that may link many.
STRONG_METHODS = ("crm_fk", "external_id", "admin_crosswalk", "human_confirmed")
STRONG_KINDS = ("external_id", "crm_fk", "admin")


@dataclass(frozen=True)
class Config:
    """Guard rails of the fold; per-kind settings fall back to the defaults."""

    min_independent_keys: int = 1
    auto_merge_tier1: bool = True
    ineligible_kinds: tuple[str, ...] = ()
    denylist: tuple[str, ...] = ()
    size_cap: int | None = None
    min_keys_of: dict[str, int] = field(default_factory=dict)


def tier1_evidence(keys: DataFrame) -> DataFrame:
    """Links between refs that share a key: ref, key_kind, namespace, key_value.

    A key of two refs links them, the smaller first. A key of more is a node of
    its own that each of its refs links to (as in star_evidence), so a key that
    a third of all refs hold gives a row for each, not for each pair.
    """
    own = keys.where("key_value IS NOT NULL").distinct()
    by = ["key_kind", "namespace", "key_value"]
    sizes = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("ref").alias("left_ref"), F.max("ref").alias("right_ref"))
    pairs = sizes.where("n = 2").select("left_ref", "right_ref", *by)
    star = own.join(sizes.where("n > 2").select(*by), by, "left_semi").select(F.col("ref").alias("left_ref"), F.concat_ws(":", F.lit("key"), "key_kind", "key_value").alias("right_ref"), *by)
    rows = pairs.unionByName(star)
    return rows.select(F.sha2(F.concat_ws("|", *by, "left_ref", "right_ref"), 256).alias("id"), "left_ref", "right_ref", F.lit(1).alias("tier"), F.col("key_kind").alias("method"), *by, F.lit(1).alias("polarity"))


def star_evidence(keys: DataFrame) -> DataFrame:
    """The same as one row for each ref and key: the key is a node of its own."""
    return keys.where("key_value IS NOT NULL").distinct().select(F.sha2(F.concat_ws("|", "key_kind", "namespace", "key_value", "ref"), 256).alias("id"), F.col("ref").alias("left_ref"), F.concat_ws(":", F.lit("key"), "key_kind", "key_value").alias("right_ref"), F.lit(1).alias("tier"), F.col("key_kind").alias("method"), "key_kind", "key_value", "namespace", F.lit(1).alias("polarity"))


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumn("a", F.least("left_ref", "right_ref")).withColumn("b", F.greatest("left_ref", "right_ref"))


def eligible(evidence: DataFrame, config: Config) -> DataFrame:
    """The rows that may link, with a, b and human (a person confirmed the pair)."""
    live = _pair(evidence)
    human = live.where("method = 'human_confirmed' AND polarity >= 0").select("a", "b").distinct().withColumn("human", F.lit(True))
    use = live.where((F.col("polarity") >= 0) & (F.col("method") != "human_rejected") & ~F.col("key_kind").isin(*config.ineligible_kinds, "") & ~F.coalesce(F.col("key_value").isin(*config.denylist, ""), F.lit(False))).join(human, ["a", "b"], "left")
    return use.where(((F.col("tier") == 1) & F.lit(config.auto_merge_tier1)) | ((F.col("tier") == 2) & F.col("human")) | (F.col("method") == "human_confirmed"))


def is_key(c: str) -> Column:
    return F.col(c).startswith("key:")


def leaves_of(use: DataFrame) -> DataFrame:
    """Rows between a key and a ref: key, leaf, and the rest."""
    return use.where(is_key("a") != is_key("b")).select(F.when(is_key("a"), F.col("a")).otherwise(F.col("b")).alias("key"), F.when(is_key("a"), F.col("b")).otherwise(F.col("a")).alias("leaf"), "id", "tier", "method", "key_kind", "key_value", "human")


def edges(evidence: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Surviving links (a, b, ids, tier, method, human) and keys that fan out (key, members)."""
    use = eligible(evidence, config)
    direct = use.where(~is_key("a") & ~is_key("b"))
    leaves = leaves_of(use)
    sized = leaves.groupBy("key").agg(F.count_distinct("leaf").alias("members"), F.min("leaf").alias("hub"), F.max("key_kind").alias("kind"))
    fanned = sized.where((F.col("members") > 2) & ~F.col("kind").isin(*STRONG_KINDS))
    # two leaves are a pair; a strong key's many leaves all link to the smallest, which connects them alike
    star = leaves.join(sized.join(fanned.select("key"), "key", "left_anti").select("key", "hub"), "key").where("leaf <> hub")
    via = star.select(F.col("hub").alias("a"), F.col("leaf").alias("b"), "id", "tier", "method", "key_kind", "key_value", F.lit(None).cast("boolean").alias("human"))
    rows = direct.select("a", "b", "id", "tier", "method", "key_kind", "key_value", "human").unionByName(via)
    least = F.lit(config.min_independent_keys)
    for kind, n in config.min_keys_of.items():
        least = F.when(F.col("dominant") == kind, F.lit(n)).otherwise(least)
    pairs = rows.groupBy("a", "b").agg(
        F.count_distinct(F.struct("key_kind", F.coalesce("key_value", "method").alias("v"))).alias("keys"),
        F.max(F.col("method").isin(*STRONG_METHODS)).alias("strong"),
        F.max(F.coalesce("human", F.lit(False))).alias("human"),
        F.min("tier").alias("tier"),
        F.min_by("method", F.struct("tier", "method")).alias("method"),
        F.min_by("key_kind", F.struct("tier", "key_kind")).alias("dominant"),
        F.collect_set("id").alias("ids"),
    )
    return pairs.where(F.col("strong") | F.col("human") | (F.col("keys") >= F.greatest(least, F.lit(1)))), fanned.select("key", "members")


def fold(evidence: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(aliases, reviews) of live evidence.

    aliases: ref, canonical (canon: and the smallest member), confidence,
    method, evidence_count, members. reviews: reason, root or key, size. A
    component with an anti-link inside, or over the cap, is held back whole.
    """
    evidence = kept(evidence)
    links, fanned = edges(evidence, config)
    links = kept(links)
    roots = components(links.select("a", "b"))
    sizes = roots.where(~F.col("node").startswith("key:")).groupBy("root").agg(F.count("*").alias("members"), F.min("node").alias("first"))
    anti = _pair(evidence).where("polarity < 0 OR method = 'human_rejected'").select("a", "b").distinct()
    at = lambda c, n: roots.select(F.col("node").alias(c), F.col("root").alias(n))
    split = anti.join(at("a", "ra"), "a").join(at("b", "rb"), "b").where("ra = rb").select(F.col("ra").alias("root")).distinct().withColumn("anti", F.lit(True))
    judged = sizes.where("members >= 2").join(split, "root", "left")
    over = F.col("members") > config.size_cap if config.size_cap is not None else F.lit(False)
    held = judged.withColumn("reason", F.when(F.col("anti"), "anti_link_split").when(over, "size_cap_exceeded"))
    badge = links.join(at("a", "root"), "a").groupBy("root").agg(F.min("tier").alias("best"), F.max("human").alias("human"), F.min_by("method", F.struct("tier", "method")).alias("method"), F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("evidence_count"))
    confidence = F.when(F.col("best") == 1, "deterministic").when(F.col("human"), "human_confirmed").otherwise("approximated")
    good = held.where("reason IS NULL").join(badge, "root").select("root", F.concat(F.lit("canon:"), "first").alias("canonical"), confidence.alias("confidence"), "method", "evidence_count", "members")
    aliases = roots.where(~F.col("node").startswith("key:")).join(good, "root").select(F.col("node").alias("ref"), "canonical", "confidence", "method", "evidence_count", "members")
    reviews = held.where("reason IS NOT NULL").select("reason", F.col("first").alias("subject"), "members").unionByName(fanned.select(F.lit("key_fan_out").alias("reason"), F.col("key").alias("subject"), "members"))
    return aliases, reviews


def drift(aliases: DataFrame, prior: DataFrame, floor: int = 8) -> DataFrame:
    """New canonicals that fuse two prior ones or more and are large or below tier 1: they go to review."""
    rows = aliases.join(prior.select("ref", F.col("canonical").alias("before")), "ref")
    fused = rows.groupBy("canonical").agg(F.count_distinct("before").alias("fused"), F.max("members").alias("members"), F.max(F.col("confidence") != "deterministic").alias("weak"))
    return fused.where((F.col("fused") >= 2) & ((F.col("members") >= floor) | F.col("weak")))


def canonical_entities(aliases: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """Merged entities first, then entities without an alias, within one limit."""
    merged = aliases.groupBy("canonical").agg(F.count("*").alias("members")).select(F.lit(0).alias("part"), F.col("canonical").alias("entity"), "members")
    single = entities.join(aliases.select("ref"), "ref", "left_anti").select(F.lit(1).alias("part"), F.col("ref").alias("entity"), F.lit(1).cast("long").alias("members"))
    return merged.unionByName(single).orderBy("part", "entity").limit(limit).select("entity", "members")


def review_queue(evidence: DataFrame, aliases: DataFrame, now: int, limit: int) -> DataFrame:
    """Undecided positive evidence by priority: frequency, size of the entities, tier, recency, age."""
    live = _pair(evidence.where("valid_to IS NULL"))
    positive = live.where("polarity = 1")
    against = live.where("polarity = -1").select("a", "b").distinct()
    shared = aliases.select(F.col("ref").alias("left_ref"), F.col("canonical").alias("c1")), aliases.select(F.col("ref").alias("right_ref"), F.col("canonical").alias("c2"))
    open_ = positive.where("method NOT IN ('human_confirmed', 'human_rejected')").join(against, ["a", "b"], "left_anti").join(shared[0], "left_ref", "left").join(shared[1], "right_ref", "left").where("NOT (c1 <=> c2 AND c1 IS NOT NULL)")
    freq = positive.groupBy("a", "b").agg(F.count("*").alias("frequency"))
    size = aliases.groupBy("canonical").agg(F.count("*").alias("n"))
    rows = open_.join(freq, ["a", "b"]).join(size.select(F.col("canonical").alias("c1"), F.col("n").alias("n1")), "c1", "left").join(size.select(F.col("canonical").alias("c2"), F.col("n").alias("n2")), "c2", "left")
    value = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
    days = (F.lit(now) - F.col("valid_from")) / 86400.0
    tier = F.when(F.col("tier") == 1, 1.2).when(F.col("tier") == 2, 1.0).otherwise(0.4)
    score = 1.5 * F.log(1.0 + F.col("frequency")) + F.log(1.0 + value) + 2.0 * tier + F.exp(-days / 14.0) + 0.2 * days
    return rows.select("id", "left_ref", "right_ref", "frequency", value.alias("entity_value"), F.round(score, 6).alias("priority"), "valid_from").orderBy(F.desc("priority"), "valid_from", "id").limit(limit)


def trigrams(name: Column) -> Column:
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def _alike_names(entities: DataFrame, threshold: float) -> DataFrame:
    """left_name, right_name, by_name: pairs of different names, each name also with itself, that are alike.

    Instead of all pairs of names, those are compared that share one of their
    rarest trigrams: at a Jaccard of t two sets share an element among the
    first (1 - t) * size + 1 in any fixed order, so each name files under so
    many of its trigrams, rarest first, and likewise words. No pair over the
    threshold is lost, and common trigrams bring no candidates together.
    """
    names = entities.select("name").where("name IS NOT NULL").distinct().withColumn("words", F.array_distinct(F.filter(F.split("name", " "), lambda w: w != ""))).withColumn("grams", F.when(F.col("name") != "", trigrams(F.col("name"))))

    def filed(column: str) -> DataFrame:
        x = names.select("name", F.explode(column).alias("g"), F.size(column).alias("n"))
        often = x.groupBy("g").agg(F.count("*").alias("df"))
        rank = Window.partitionBy("name").orderBy("df", "g")
        return x.join(often, "g").withColumn("k", F.row_number().over(rank)).where(F.col("k") <= F.floor((1 - threshold) * F.col("n") + 1e-9) + 1).select("name", F.concat(F.lit(column), F.lit(":"), "g").alias("key"))

    keys = filed("grams").unionByName(filed("words"))
    met = keys.alias("l").join(keys.alias("r"), "key").where("l.name <= r.name").select(F.col("l.name").alias("left_name"), F.col("r.name").alias("right_name")).distinct()
    side = lambda s: names.select(*[F.col(c).alias(f"{s}_{c}") for c in ("name", "words", "grams")])
    by_name = F.coalesce(F.greatest(jaccard(F.col("left_words"), F.col("right_words")), jaccard(F.col("left_grams"), F.col("right_grams"))), F.lit(0.0))
    return met.join(side("left"), "left_name").join(side("right"), "right_name").withColumn("by_name", by_name).where(F.col("by_name") >= threshold).select("left_name", "right_name", "by_name")


def block_classes(entities: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Candidates as classes instead of pairs (kind, left_ref, right_ref, score) of entities (ref, name, domain).

    name: the first refs of two different names that are alike; member: a ref
    and the first one of its name; domain: a ref and the first one of its
    domain (0.9). Two refs are candidates just when their names are one or
    alike, or their domains equal, so no pair is lost, and a name or domain
    that a third of all refs have gives a row for each of them.
    """
    e = entities.select("ref", "name", "domain")
    first = e.where("name IS NOT NULL").groupBy("name").agg(F.min("ref").alias("rep"))
    rep = lambda s: first.select(F.col("name").alias(f"{s}_name"), F.col("rep").alias(f"{s}_rep"))
    alike = _alike_names(e, threshold).where("left_name <> right_name").join(rep("left"), "left_name").join(rep("right"), "right_name")
    named = alike.select(F.lit("name").alias("kind"), F.least("left_rep", "right_rep").alias("left_ref"), F.greatest("left_rep", "right_rep").alias("right_ref"), F.round("by_name", 4).alias("score"))
    member = e.join(first, "name").where("ref <> rep").select(F.lit("member").alias("kind"), F.col("rep").alias("left_ref"), F.col("ref").alias("right_ref"), F.lit(1.0).alias("score"))
    hubs = e.where("domain IS NOT NULL").groupBy("domain").agg(F.min("ref").alias("rep"))
    domain = e.join(hubs, "domain").where("ref <> rep").select(F.lit("domain").alias("kind"), F.col("rep").alias("left_ref"), F.col("ref").alias("right_ref"), F.lit(0.9).alias("score"))
    return named.unionByName(member).unionByName(domain).distinct()


def _name_key() -> Column:
    """A name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "name"), F.lit(""))


def _put_in(classes: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs of refs (left_ref < right_ref) for classes (domain, a <= b: names as keys), with what else these have."""
    side = lambda ref, name: entities.where("domain IS NOT NULL").select("domain", F.col("ref").alias(ref), _name_key().alias(name))
    rows = classes.join(side("x", "a"), ["domain", "a"]).join(side("y", "b"), ["domain", "b"]).where("x < y OR (x > y AND a <> b)")
    return rows.select(F.least("x", "y").alias("left_ref"), F.greatest("x", "y").alias("right_ref"), *[c for c in classes.columns if c not in ("a", "b")])


#: Refs of one name and domain that stand in one row; two such rows are expanded into their pairs within a task.
BLOCK = 256


def block_pairs(entities: DataFrame, threshold: float = 0.45, decided: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Candidate pairs (left_ref, right_ref, score) of entities (ref, name, domain; canonical forms), expanded.

    The larger Jaccard of name words and of trigrams; an equal domain counts
    0.9. Classes, the refs of one name and one domain, are compared and scored,
    not refs. A class is cut into blocks of about ``block`` refs by hash; pairs
    of blocks are dealt out evenly and only then expanded, so the largest
    class is spread like any other and a task holds the pairs of two blocks
    at most. As many rows as there are pairs: where names or domains are
    shared by many, take ``block_classes``.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns])
    e = entities.select("ref", _name_key().alias("name"), key("domain").alias("domain"))
    sizes = e.groupBy("name", "domain").agg(F.ceil(F.count("*") / block).alias("n"))
    classes = sizes.select("name", "domain")
    alike = _alike_names(entities, threshold).select(key("left_name").alias("x_name"), key("right_name").alias("y_name"), F.col("by_name").alias("raw"))
    named = alike.join(side(classes, "x"), "x_name").join(side(classes, "y"), "y_name")
    shared = classes.where("domain <> ''")
    same = side(shared, "x").withColumn("y_domain", F.col("x_domain")).join(side(shared, "y"), "y_domain").withColumn("raw", F.lit(0.9))
    ordered = "x_name < y_name OR (x_name = y_name AND x_domain <= y_domain)"
    of_classes = ["x_name", "x_domain", "y_name", "y_domain"]
    met = named.unionByName(same).where(ordered).groupBy(*of_classes).agg(F.max("raw").alias("raw")).where(F.col("raw") >= threshold)

    blocks = e.join(sizes, ["name", "domain"]).groupBy("name", "domain", F.pmod(F.xxhash64("ref"), "n").alias("at")).agg(F.collect_list("ref").alias("refs"))
    places = blocks.select("name", "domain", "at")
    sc = entities.sparkSession.sparkContext
    dealt = met.join(side(places, "x"), ["x_name", "x_domain"]).join(side(places, "y"), ["y_name", "y_domain"]).withColumn("own", F.expr("x_name = y_name AND x_domain = y_domain")).where("NOT own OR x_at <= y_at")
    full = dealt.join(side(blocks, "x"), ["x_name", "x_domain", "x_at"])
    of_y = ["y_name", "y_domain", "y_at"]
    full = full.repartition(8 * sc.defaultParallelism, *of_y).join(side(blocks, "y"), of_y)
    # within one block each pair is met twice
    once = full.select(F.expr("own AND x_at = y_at").alias("one"), F.round("raw", 4).alias("score"), "y_refs", F.explode("x_refs").alias("x")).select("one", "score", "x", F.explode("y_refs").alias("y")).where("x < y OR (x > y AND NOT one)")
    pairs = once.select(F.expr("IF(x < y, x, y)").alias("left_ref"), F.expr("IF(x < y, y, x)").alias("right_ref"), "score")
    if decided is not None:
        pairs = pairs.join(decided.select(F.least("a", "b").alias("left_ref"), F.greatest("a", "b").alias("right_ref")), ["left_ref", "right_ref"], "left_anti")
    return pairs


def mentions(texts: DataFrame, gazetteer: DataFrame, longest: int = 5) -> DataFrame:
    """Where a text's words are a surface form: id, form, at (word number from 0). gazetteer: form, canonical.

    Forms are as name() makes them, of up to ``longest`` words. Each place with
    its next words is one row, met by the forms that begin with its first word,
    so longer runs are looked at only where one may stand.
    """
    words = texts.select("id", F.filter(F.split(F.trim(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "").alias("w")).where("size(w) > 0")
    forms = gazetteer.select("form", F.split("form", " ").alias("f")).where(F.size("f") <= longest).distinct().withColumn("first", F.get("f", F.lit(0)))
    places = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(i.alias("at"), F.get(F.col("w"), i).alias("first"), F.slice("w", i + 1, F.lit(longest)).alias("run")))
    spans = words.select("id", F.inline(places))
    return spans.join(forms, "first").where(F.slice("run", F.lit(1), F.size("f")) == F.col("f")).select("id", "at", "form")


def decide_mentions(candidates: DataFrame, tau: float = 0.70, delta: float = 0.15, auto: bool = False) -> DataFrame:
    """One decision per mention from its candidates (mention, canonical, score, co_signal, folded, human)."""
    order = Window.partitionBy("mention").orderBy(F.desc("score"), "canonical")
    top = candidates.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("r = 1")
    gate = F.col("folded") & (F.col("co_signal") | F.col("human") | F.lit(auto))
    outcome = F.when(F.col("score") < tau, "nil").when(F.round(F.col("score") - F.col("second"), 9) < delta, "abstain_margin").when(gate, "tag").otherwise("reviewer_hint")
    return top.select("mention", "canonical", "score", outcome.alias("outcome"))


def surface_score(mention: Column, form: Column, co_signal: Column) -> Column:
    """1 for an equal form, else the Jaccard of their words, raised by 0.4 up to 1 with a co-signal."""
    split = lambda c: F.array_distinct(F.split(c, " "))
    base = F.when(mention == form, 1.0).otherwise(jaccard(split(mention), split(form)))
    return F.round(F.when(co_signal, F.least(F.lit(1.0), base + 0.4)).otherwise(base), 4)


#: Names that are sent to every task; more are met by runs of letters.
NAMES_SENT = 20_000


def echo_tags(chunks: DataFrame, entities: DataFrame, least: int = 3, sent: int = NAMES_SENT) -> DataFrame:
    """Suggested tags: an entity's bare name stands in a chunk that lacks the tag (confidence 0.95).

    entities: entity. Up to ``sent`` of them are sent to every task and looked
    for in each chunk as it is read. Of more, names and chunks are cut into
    runs of ``least`` letters, and only chunks that hold a name's rarest run
    are tested for it.
    """
    own = entities.select("entity", F.lower(F.element_at(F.split("entity", ":"), -1)).alias("bare")).where(F.length("bare") >= least).distinct()
    text = chunks.select("id", "tags", F.lower("content").alias("s"))
    if own.limit(sent + 1).count() <= sent:
        rows = text.join(F.broadcast(own), F.col("s").contains(F.col("bare")))  # counted above
    else:
        runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substr(c, i, F.lit(least))))
        grams = text.where(F.length("s") >= least).select("id", F.explode(runs(F.col("s"))).alias("g"))
        often = grams.groupBy("g").agg(F.count("*").alias("df"))
        rarest = own.select("entity", "bare", F.explode(runs(F.col("bare"))).alias("g")).join(often, "g", "left").groupBy("entity", "bare").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g"))
        rows = grams.join(rarest, "g").select("id", "entity", "bare").join(text, "id").where(F.col("s").contains(F.col("bare")))
    return rows.where(~F.array_contains("tags", F.col("entity"))).select("id", "entity", F.lit(0.95).alias("confidence"))


def tier2_evidence(candidates: DataFrame, entities: DataFrame, namespace: str, at: int) -> DataFrame:
    """Evidence of tier 2 for blocked pairs (left_ref, right_ref, score) that the rule judge calls the same.

    The same are parties of one domain whose names share a word; one domain
    with names that disagree, different domains, or a domain that is not known
    are too little, so nothing is said.
    """
    own = lambda side: entities.select(F.col("ref").alias(f"{side}_ref"), F.split("name", " ").alias(f"{side}_words"), F.col("domain").alias(f"{side}_domain"))
    rows = candidates.join(own("left"), "left_ref").join(own("right"), "right_ref")
    agree = F.coalesce(F.arrays_overlap(*[F.filter(f"{side}_words", lambda w: w != "") for side in ("left", "right")]), F.lit(False))
    same = rows.where((F.col("left_domain") == F.col("right_domain")) & agree)
    return _tier2(same.withColumnRenamed("left_domain", "domain"), namespace, at)


def _tier2(same: DataFrame, namespace: str, at: int) -> DataFrame:
    """Pairs (left_ref, right_ref, domain, score) as evidence."""
    return same.select(
        F.sha2(F.concat_ws("|", F.lit("tier2"), "left_ref", "right_ref"), 256).alias("id"), "left_ref", "right_ref", F.lit(2).alias("tier"), F.lit("name_match").alias("method"), F.lit("name_match").alias("key_kind"),
        F.concat(F.lit("name+domain_fuzzy; judge: exact shared domain "), "domain").alias("key_value"), F.lit(namespace).alias("namespace"), F.lit(1).alias("polarity"), F.lit(at).cast("long").alias("valid_from"), "score",
    )


def tier2_of_domains(entities: DataFrame, namespace: str, at: int, least: float = 0.9) -> DataFrame:
    """``tier2_evidence`` of all blocked pairs of entities (ref, name, domain), without making the pairs that it says nothing of.

    What the judge calls the same has one domain, so such pairs are blocked
    whatever their names (score ``least`` or more). Different names of a domain meet by their words,
    each pair of names is judged once, and refs are put in last: what is shuffled follows
    the names and refs, only the result the pairs.
    """
    e = entities.select("ref", "name", "domain")
    named = e.where("domain IS NOT NULL AND name IS NOT NULL").select("domain", "name").distinct().withColumn("k", _name_key())
    words = F.array_distinct(F.filter(F.split("name", " "), lambda w: w != ""))
    met = named.select("domain", "k", F.explode(words).alias("w"))
    pairs = met.select("domain", "w", F.col("k").alias("a")).join(met.select("domain", "w", F.col("k").alias("b")), ["domain", "w"]).where("a <= b").select("domain", "a", "b").distinct()
    sets = named.select("k", "name").distinct().select("k", words.alias("words"), trigrams(F.col("name")).alias("grams"))
    of = lambda key: sets.select(F.col("k").alias(key), F.struct("words", "grams").alias(f"s{key}"))
    alike = F.greatest(*[F.coalesce(jaccard(F.col(f"sa.{c}"), F.col(f"sb.{c}")), F.lit(0.0)) for c in ("words", "grams")], F.lit(least))
    judged = pairs.join(of("a"), "a").join(of("b"), "b").select("domain", "a", "b", F.round(alike, 4).alias("score"))
    return _tier2(_put_in(judged, e), namespace, at)


def human_decisions(decisions: DataFrame, namespace: str) -> DataFrame:
    """Decisions (left_ref, right_ref, confirm, at) as evidence to append: a link of tier 2, or an anti-link for good."""
    method = F.when(F.col("confirm"), "human_confirmed").otherwise("human_rejected")
    return decisions.select(
        F.sha2(F.concat_ws("|", F.lit("human"), "left_ref", "right_ref", F.col("at").cast("string")), 256).alias("id"), "left_ref", "right_ref", F.lit(2).alias("tier"), method.alias("method"), method.alias("key_kind"),
        F.lit(None).cast("string").alias("key_value"), F.lit(namespace).alias("namespace"), F.when(F.col("confirm"), 1).otherwise(-1).alias("polarity"), F.col("at").alias("valid_from"),
    )


def chunk_tags(evidence: DataFrame, known: DataFrame, auto: bool = False) -> DataFrame:
    """Tags that mentions put on chunks: chunk (ref), tags, confidence.

    evidence links a chunk (chunk:...) with what it mentions; known: canonical
    names that are folded already. Tags come only where linking is automatic
    or other evidence on the chunk, of tier 2 or better or a human's, anchors
    it. A mention of a member stands for its own canonical if that is folded
    and the chunk is anchored. A chunk without a known canonical gets none.
    """
    is_chunk = lambda c: F.col(c).startswith("chunk:")
    rows = evidence.where((F.col("polarity") >= 0) & (is_chunk("left_ref") | is_chunk("right_ref")))
    rows = rows.select(F.when(is_chunk("left_ref"), F.col("left_ref")).otherwise(F.col("right_ref")).alias("chunk"), F.when(is_chunk("left_ref"), F.col("right_ref")).otherwise(F.col("left_ref")).alias("other"), ((F.col("tier") <= 2) | (F.col("method") == "human_confirmed")).alias("anchors"))
    anchored = rows.groupBy("chunk").agg(F.max("anchors").alias("anchored"))
    folded = known.select(F.col("canonical").alias("tag")).distinct()
    direct = rows.select("chunk", F.col("other").alias("tag"), F.lit(False).alias("member")).unionByName(rows.where(~F.col("other").startswith("canon:")).select("chunk", F.concat(F.lit("canon:"), "other").alias("tag"), F.lit(True).alias("member")))
    own = direct.distinct().join(folded, "tag").join(anchored, "chunk").where((F.lit(auto) | F.col("anchored")) & (~F.col("member") | F.col("anchored")))
    confidence = F.when(F.first("anchored"), "deterministic").otherwise("approximated")
    return own.groupBy("chunk").agg(F.array_sort(F.collect_set("tag")).alias("tags"), confidence.alias("confidence"))


def resolve_all(evidence: DataFrame, chunks_evidence: DataFrame, config: Config, prior: DataFrame, auto: bool = False) -> dict[str, DataFrame]:
    """One resolution run: the fold of all live evidence, what it holds back, drift against the prior aliases, and chunk tags."""
    aliases, reviews = fold(evidence, config)
    aliases = kept(aliases)
    known = aliases.select("canonical").unionByName(prior.select("canonical"))
    return {"aliases": aliases, "reviews": reviews, "drift": drift(aliases, prior), "tags": chunk_tags(chunks_evidence, known, auto)}
