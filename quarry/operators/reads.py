"""Listing reads over the governed tables: latest chunks, timelines, browsing, briefs, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.scope import Scope, scoped, scoped_chunks, scoped_facts


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def latest_chunks(chunks: DataFrame, scope: Scope, entity: str, limit: int = 20) -> DataFrame:
    """Newest current chunks that hold the entity, which a bound scope must name itself."""
    if scope.entities and entity not in scope.entities:
        return chunks.where(F.lit(False))
    return scoped(chunks, scope).where(F.array_contains("tags", entity)).orderBy(F.desc("valid_from"), F.desc("id")).limit(clamp(limit, 100))


def of_types(types: list[str]) -> Column:
    """Exact action types, or all below a prefix written ``prefix.*``."""
    exact = [t for t in types if not t.endswith(".*")]
    below = [F.col("action_type").startswith(t[:-1]) for t in types if t.endswith(".*")]
    return reduce(lambda a, c: a | c, below, F.col("action_type").isin(*exact) if exact else F.lit(False))


def activity(actions: DataFrame, scope: Scope, entity: str | None = None, since: int | None = None, types: list[str] | None = None, actors: list[str] | None = None, limit: int = 100) -> DataFrame:
    """The newest actions first. Filters that are not given leave no trace in the plan."""
    if scope.entities and entity is not None and entity not in scope.entities:
        return actions.where(F.lit(False))
    rows = scoped(actions, scope)
    if entity is not None:
        rows = rows.where(F.array_contains("entities", entity))
    elif scope.entities:
        rows = rows.where(F.arrays_overlap("entities", F.array(*map(F.lit, scope.entities))))
    if since is not None:
        rows = rows.where(F.col("occurred_at") >= since)
    if types:
        rows = rows.where(of_types(types))
    if actors:
        rows = rows.where(F.col("actor").isin(*actors))
    return rows.orderBy(F.desc("occurred_at"), F.desc("action_id")).limit(clamp(limit, 500))


PREVIEW = 240


def memories(chunks: DataFrame, facts: DataFrame, actions: DataFrame, scope: Scope, kind: str | None = None, source: str | None = None, entity: str | None = None, text: str | None = None, ident: int | None = None, history: bool = False) -> DataFrame:
    """Chunks, facts and actions in one shape, each under the scope's access and entity fence.

    Filters that are not given leave no trace in the plan. ``text`` is looked
    for without regard to case; an id lookup shows a replaced row too, and its
    content whole.
    """
    if kind not in (None, "chunk", "fact", "action"):
        raise ValueError(f"kind must be chunk, fact or action, not {kind!r}")
    whole = ident is not None
    null = lambda t: F.lit(None).cast(t)

    def shape(df: DataFrame, name: str, key: str, src: Column, at: str, said: Column, has: Column, own: dict[str, Column]) -> DataFrame:
        if kind not in (None, name):
            df = df.where(F.lit(False))
        if source is not None:
            df = df.where(src == source)
        if entity is not None:
            df = df.where(F.array_contains(has, entity))
        if text is not None:
            df = df.where(F.contains(F.lower(said), F.lit(text.lower())))
        if whole:
            df = df.where(F.col(key) == ident)
        extra = {"entity_id": null("string"), "field": null("string"), "document_id": null("long"), "seq": null("int"), "action_type": null("string"), "valid_to": null("long")} | own
        return df.select(F.lit(name).alias("kind"), F.col(key).alias("id"), src.alias("source"), F.col(at).alias("recorded_at"), (said if whole else F.left(said, F.lit(PREVIEW))).alias("preview"), (F.lit(not whole) & (F.length(said) > PREVIEW)).alias("truncated"), F.array_join(has, ",").alias("entities"), F.size("visibility").alias("visible_to"), F.col("confidentiality"), *[c.alias(n) for n, c in extra.items()])

    current = not (history or whole)
    closed = {"valid_to": F.col("valid_to")}
    # a bound scope sees actions that name one of its entities, as in the timeline
    acts = scoped(actions, scope, F.arrays_overlap("entities", F.array(*map(F.lit, scope.entities))) if scope.entities else None)
    return (
        shape(scoped_chunks(chunks, scope, current), "chunk", "id", F.col("source"), "valid_from", F.col("content"), F.col("tags"), {"document_id": F.col("document_id"), "seq": F.col("seq")} | closed)
        .unionByName(shape(scoped_facts(facts, scope, current), "fact", "id", F.col("source"), "valid_from", F.coalesce("value", F.lit("")), F.array(F.concat("source", F.lit(":"), "entity_id")), {"entity_id": F.col("entity_id"), "field": F.col("field")} | (closed if "valid_to" in facts.columns else {})))
        .unionByName(shape(acts, "action", "action_id", F.lit("agent"), "occurred_at", F.col("summary"), F.col("entities"), {"action_type": F.col("action_type")}))
    )


def page(rows: DataFrame, limit: int, after: tuple[int, str, int] | None = None) -> DataFrame:
    """A page of memories, newest first, after a keyset cursor (recorded_at, kind, id).

    One row more than the page is taken; has_more says on every row whether it was there.
    """
    if after is not None:
        rows = rows.where(F.struct("recorded_at", "kind", "id") < F.struct(F.lit(after[0]).cast("long"), F.lit(after[1]), F.lit(after[2]).cast("long")))
    limit = clamp(limit, 200)
    order = [F.desc("recorded_at"), F.desc("kind"), F.desc("id")]
    # at most limit + 1 rows reach the window
    taken = rows.orderBy(*order).limit(limit + 1).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    more = F.max("place").over(Window.partitionBy()) > limit
    return taken.withColumn("has_more", more).where(F.col("place") <= limit).drop("place")


def intersection(visibilities: Column) -> Column:
    """What all of an array of visibilities share; nobody if there are none."""
    first = F.coalesce(F.get(visibilities, F.lit(0)), F.array().cast("array<bigint>"))
    return F.array_sort(F.aggregate(visibilities, first, lambda a, v: F.array_intersect(a, v)))


def brief_sources(chunks: DataFrame, actions: DataFrame, tenant: str, n: int = 10) -> DataFrame:
    """Per entity: how many of its newest chunks and actions a brief draws on, and who may see all of them.

    The newest n of a kind are taken with a ranking window, whose filter Spark
    turns into a per-task limit before the shuffle, so a hot entity sends few rows.
    """
    one = chunks.where((F.col("tenant") == tenant) & F.col("valid_to").isNull()).select(F.explode("tags").alias("entity"), F.lit("chunk").alias("kind"), "id", F.col("valid_from").alias("at"), "visibility")
    two = actions.where(F.col("tenant") == tenant).select(F.explode("entities").alias("entity"), F.lit("action").alias("kind"), F.col("action_id").alias("id"), F.col("occurred_at").alias("at"), "visibility")
    newest = Window.partitionBy("entity", "kind").orderBy(F.desc("at"), F.desc("id"))
    top = one.unionByName(two).withColumn("r", F.row_number().over(newest)).where(F.col("r") <= n)
    folded = top.groupBy("entity").agg(F.count("*").alias("n_sources"), F.collect_list("visibility").alias("vs"))
    return folded.select("entity", "n_sources", F.array_join(intersection(F.col("vs")), ",").alias("source_visibility"))


def brief(briefs: DataFrame, scope: Scope, *more: Column | str) -> DataFrame:
    """Briefs with their summary only where the caller may see all its sources: entity, summary, and ``more`` of their columns."""
    seen = F.coalesce(F.arrays_overlap("source_visibility", F.array(*[F.lit(p) for p in scope.principals]).cast("array<bigint>")), F.lit(False))
    return briefs.select("entity", F.when(seen, F.col("summary")).alias("summary"), *more)


def refreshed_briefs(briefs: DataFrame, stale: DataFrame, chunks: DataFrame, actions: DataFrame, tenant: str, at: int, n: int = 10) -> DataFrame:
    """Briefs (entity, summary, source_visibility, refreshed_at) with those of stale entities (entity) made anew.

    A summary draws on the newest ``n`` chunks and actions of its entity and
    names them by time; it may be read by those that see all of them. An entity
    without sources loses its brief; one that had none gets one. Only rows of
    stale entities are ranked; the others keep what they have.
    """
    due = stale.select("entity").distinct()
    one = chunks.where((F.col("tenant") == tenant) & F.col("valid_to").isNull()).select(F.explode("tags").alias("entity"), F.lit("chunk").alias("kind"), "id", F.col("valid_from").alias("at"), "visibility")
    two = actions.where(F.col("tenant") == tenant).select(F.explode("entities").alias("entity"), F.lit("action").alias("kind"), F.col("action_id").alias("id"), F.col("occurred_at").alias("at"), "visibility")
    newest = Window.partitionBy("entity", "kind").orderBy(F.desc("at"), F.desc("id"))
    top = one.unionByName(two).join(due, "entity", "left_semi").withColumn("r", F.row_number().over(newest)).where(F.col("r") <= n)
    line = F.concat_ws(":", "kind", F.col("id").cast("string"))
    folded = top.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "id", line.alias("line"))), asc=False).alias("s"), F.collect_list("visibility").alias("vs"))
    fresh = folded.select("entity", F.array_join("s.line", " ").alias("summary"), intersection(F.col("vs")).alias("source_visibility"), F.lit(at).cast("long").alias("refreshed_at"))
    # no entity is on both sides. Spark 4.1 may fail on a union of two sides that are shuffled alike ("can't zip"), where
    # adaptive execution gives them different numbers of partitions; a join gives them the same
    rest = briefs.select(*fresh.columns).join(due, "entity", "left_anti")
    both = rest.join(fresh.select("entity", *[F.col(c).alias(f"new_{c}") for c in fresh.columns[1:]]), "entity", "full_outer")
    return both.select("entity", *[F.coalesce(c, f"new_{c}").alias(c) for c in fresh.columns[1:]])


def entity_tags(chunks: DataFrame, actions: DataFrame, tenant: str) -> DataFrame:
    """The directory of entities: live and all chunks, actions, last seen. Partial sums go before the shuffle."""
    one = chunks.where(F.col("tenant") == tenant).select(F.explode("tags").alias("entity"), F.col("valid_to").isNull().cast("long").alias("live"), F.lit(1).alias("c"), F.lit(0).alias("a"), F.col("valid_from").alias("at"))
    two = actions.where(F.col("tenant") == tenant).select(F.explode("entities").alias("entity"), F.lit(0).cast("long").alias("live"), F.lit(0).alias("c"), F.lit(1).alias("a"), F.col("occurred_at").alias("at"))
    rows = one.unionByName(two).groupBy("entity").agg(F.sum("live").alias("live_chunks"), F.sum("c").alias("chunks"), F.sum("a").alias("actions"), F.max("at").alias("last_seen"))
    return rows.withColumn("namespace", F.substring_index("entity", ":", 1))
