"""Roles above roles, and what managers see through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import kept

#: Levels above a role that are followed.
DEEPEST = 64


def role_ancestors(roles: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(role, ancestor, level) of roles (role, parent): every role above each, the nearest first.

    A cycle ends where it comes back to a role that was passed already, which
    is then not its own ancestor. A role has one parent at most, so a level
    adds a row for each role at most.

    A round puts the levels above the furthest ancestor behind those below it,
    so levels double: a tree of depth d takes log2 d rounds, each of which is
    written. Above a role all ancestors differ, so what comes back to a role
    passed is found by equality, and behind it everything comes back.
    """
    up = kept(roles.where("role IS NOT NULL AND parent IS NOT NULL AND role <> parent").groupBy("role").agg(F.min("parent").alias("ancestor")).withColumn("level", F.lit(1)))
    pairs, far, reach = up, up, 1
    while reach < deepest and not far.isEmpty():
        above = pairs.select(F.col("role").alias("via"), F.col("ancestor").alias("a"), (F.col("level") + reach).alias("l"))
        further = far.select("role", F.col("ancestor").alias("via")).join(above, "via").where((F.col("role") != F.col("a")) & (F.col("l") <= deepest)).select("role", F.col("a").alias("ancestor"), F.col("l").alias("level"))
        new = kept(further.join(pairs.select("role", "ancestor"), ["role", "ancestor"], "left_anti").select("role", "ancestor", "level"))
        reach *= 2
        pairs, far = pairs.unionByName(new), new.where(F.col("level") == reach)
    return pairs


def reaching(records: DataFrame, users: DataFrame, roles: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Rows (record, user) of ``role_grants``, of which some may come more than once.

    A record takes its parent's owners before these are put through the tree, so what is long is made once.
    """
    owned = records.join(users.select(F.col("user").alias("owner"), "role"), "owner").select("record", "role")
    if parents is not None:
        kids = parents.select(F.col("record").alias("kid"), F.col("parent").alias("record"))
        inherited = owned.join(kids, "record").select(F.col("kid").alias("record"), "role")
        owned = owned.join(kids.select(F.col("kid").alias("record")), "record", "left_anti").unionByName(inherited)
    above = role_ancestors(roles).join(users.select("user", F.col("role").alias("ancestor")), "ancestor").select("role", "user")
    return owned.join(above, "role").select("record", "user")


def role_grants(records: DataFrame, users: DataFrame, roles: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(record, user): users in a role above that of a record's owner, by record.

    records: record, owner; users: user, role; parents: record, parent, whose
    grants the record has instead of its own (records controlled by a parent).
    """
    return reaching(records, users, roles, parents).distinct()
