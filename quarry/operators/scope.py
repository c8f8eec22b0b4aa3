"""Who may see what: scopes, their compilation, and the predicate every read carries.

A read filters by tenant, currency, visibility, class and entity fence before
it ranks or limits anything. An empty set of principals sees nothing, by a
literal false that the optimizer folds before any file is read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.schema import CONFIDENTIAL
from quarry.session import kept

#: Retention of revocations: the longest life of a scope and an hour, in seconds.
REVOCATION_WINDOW = 13 * 3600


@dataclass(frozen=True)
class Scope:
    tenant: str
    principals: tuple[int, ...]
    ceiling: int = CONFIDENTIAL
    entities: tuple[str, ...] = ()
    issued_at: int = 0


@dataclass(frozen=True)
class Purpose:
    """What a declared purpose does to a scope: it clamps the class and may demand entities."""

    ceiling: int
    needs_entities: bool = False


def compile_scope(scope: Scope, tombstones: DataFrame, revoked: DataFrame, purpose: Purpose | None = None, has_engine: bool = True, lag: int | None = None, lag_bound: int = 60) -> Scope:
    """Clamps the class, takes revoked tokens away and fails closed where membership is stale.

    tombstones (token, at) and revoked (token) are filtered to the scope's own
    tokens before they reach the driver, so what comes back is bounded by it.
    """
    ceiling = min(scope.ceiling, purpose.ceiling if purpose else scope.ceiling, scope.ceiling if has_engine else CONFIDENTIAL)
    if purpose and purpose.needs_entities and not scope.entities:
        return replace(scope, ceiling=ceiling, principals=())
    if lag is not None and lag > lag_bound:
        return replace(scope, ceiling=ceiling, principals=())
    gone = {r["token"] for r in subtract_tokens(list(scope.principals), tombstones, revoked, scope.issued_at).where("NOT kept").select("token").collect()}
    return replace(scope, ceiling=ceiling, principals=tuple(p for p in scope.principals if p not in gone))


def subtract_tokens(tokens: list[int] | DataFrame, tombstones: DataFrame, revoked: DataFrame, issued_at: int) -> DataFrame:
    """token, first_at, kept: a token goes if it is revoked for good, or was first revoked at or after the scope's issue."""
    own = tokens if isinstance(tokens, DataFrame) else tombstones.sparkSession.createDataFrame([(t,) for t in tokens], "token long")
    first = tombstones.groupBy("token").agg(F.min("at").alias("first_at"))
    durable = revoked.select("token").distinct().withColumn("durable", F.lit(True))
    rows = own.join(first, "token", "left").join(durable, "token", "left")
    return rows.select("token", "first_at", (F.col("durable").isNull() & ~F.coalesce(F.col("first_at") >= issued_at, F.lit(False))).alias("kept"))


def windowed_revoked(tombstones: DataFrame, now: int, window: int = REVOCATION_WINDOW) -> DataFrame:
    return tombstones.where(F.col("at") > now - window).select("token").distinct()


def array_of(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def visible(scope: Scope, column: str = "visibility") -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), array_of(scope.principals, "bigint")), F.lit(False))


def chunk_fence(scope: Scope) -> Column:
    """A bound scope sees tagged chunks whose tags all lie within it, and knowledge."""
    if not scope.entities:
        return F.lit(True)
    inside = (F.size("tags") > 0) & (F.size(F.array_except("tags", array_of(scope.entities, "string"))) == 0)
    return (F.col("kind") == "knowledge") | inside


def fact_fence(scope: Scope) -> Column:
    return F.col("entity_id").isin(*scope.entities) if scope.entities else F.lit(True)


def predicate(columns: list[str], scope: Scope, fence: Column | None = None, current: bool = True) -> Column:
    """What every read filters by; false for an empty set of principals."""
    if not scope.principals:
        return F.lit(False)
    keep = (F.col("tenant") == scope.tenant) & (F.col("confidentiality") <= scope.ceiling) & visible(scope)
    if current and "valid_to" in columns:
        keep = keep & F.col("valid_to").isNull()
    return keep & fence if fence is not None else keep


def scoped(df: DataFrame, scope: Scope, fence: Column | None = None, current: bool = True) -> DataFrame:
    """The rows that the scope may see; the only way in which reads open governed tables."""
    return df.where(predicate(df.columns, scope, fence, current))


def scoped_chunks(df: DataFrame, scope: Scope, current: bool = True) -> DataFrame:
    return scoped(df, scope, chunk_fence(scope), current)


def scoped_facts(df: DataFrame, scope: Scope, current: bool = True) -> DataFrame:
    return scoped(df, scope, fact_fence(scope), current)


def drop_reasons(df: DataFrame, scope: Scope) -> Column:
    """Every reason why a scope does not see a chunk, in a fixed order; empty if it does."""
    tags, entities = F.col("tags"), array_of(scope.entities, "string")
    outside = (F.size("tags") > 0) & (F.size(F.array_except(tags, entities)) > 0)
    bound = F.lit(bool(scope.entities)) & (F.col("kind") != "knowledge")
    return F.array_compact(
        F.array(
            F.when(F.col("valid_to").isNotNull(), "stale_superseded"),
            F.when(F.size("visibility") == 0, "visibility_empty"),
            F.when((F.size("visibility") > 0) & ~visible(scope), "visibility_no_overlap"),
            F.when(F.col("confidentiality") > scope.ceiling, "confidentiality_above_ceiling"),
            F.when(bound & (F.size("tags") == 0), "entity_scope_untagged"),
            F.when(bound & outside, "entity_scope_outside"),
        )
    )


def write_entities(requested: tuple[str, ...], scope: Scope) -> tuple[str, ...]:
    """Entities a write is tagged with: a bound scope's own by default, and never others."""
    if not scope.entities:
        return requested
    if set(requested) - set(scope.entities):
        raise PermissionError("entities outside the scope")
    return requested or scope.entities


def allocate_tokens(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Numbers for new principals in order of first sight, after the largest; known ones keep theirs.

    seen: principal, at. New principals are range-partitioned by first sight and
    written; each range counts on from how many the ranges before it hold, a
    number for each of them.
    """
    fresh = seen.groupBy("principal").agg(F.min("at").alias("at")).join(known, "principal", "left_anti")
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(fresh.repartitionByRange(parts, "at", "principal").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "base")
    top = known.agg(F.coalesce(F.max("token"), F.lit(0)).alias("top"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("at", "principal"))
    new = placed.withColumn("rank", place).join(F.broadcast(before), "part").crossJoin(F.broadcast(top))
    return known.select("principal", "token").unionByName(new.select("principal", (F.col("rank") + F.col("base") + F.col("top")).cast("long").alias("token")))
