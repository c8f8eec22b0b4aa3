"""Membership closure, access graph, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import kept


def closure(edges: DataFrame) -> DataFrame:
    """All (member, ancestor) pairs of a membership graph (member, parent); cycles end by themselves.

    Every round joins the pairs found last with all, on either side, so paths
    double in length: a chain of depth d takes log2 d rounds. Only what is new
    is written in a round.
    """
    new = kept(edges.select("member", F.col("parent").alias("ancestor")).where("member IS NOT NULL AND parent IS NOT NULL").distinct())
    pairs = new
    while not new.isEmpty():
        join = lambda a, b: a.select(F.col("member").alias("m"), F.col("ancestor").alias("via")).join(b.select(F.col("member").alias("via"), F.col("ancestor").alias("a")), "via").select(F.col("m").alias("member"), F.col("a").alias("ancestor"))
        further = join(new, pairs).unionByName(join(pairs, new)).distinct()
        known = pairs.select(F.col("member").alias("m"), F.col("ancestor").alias("a"))
        new = kept(further.join(known, (F.col("member") == F.col("m")) & (F.col("ancestor") == F.col("a")), "left_anti"))
        pairs = pairs.select("member", "ancestor").unionByName(new.select("member", "ancestor"))
    return pairs


def users_via_groups(edges: DataFrame, grants: DataFrame, most_groups: int = 5) -> DataFrame:
    """Users that reach an object through groups: object, user, groups (the first few), n_groups.

    edges: member, parent; grants: object, principal. A user is a member that is no parent.
    """
    users = edges.select(F.col("member")).distinct().join(edges.select(F.col("parent").alias("member")).distinct(), "member", "left_anti")
    reach = closure(edges).join(users, "member")
    rows = reach.join(grants, reach["ancestor"] == grants["principal"]).select("object", F.col("member").alias("user"), "ancestor").distinct()
    via = rows.groupBy("object", "user").agg(F.array_sort(F.collect_set("ancestor")).alias("g"))
    return via.select("object", "user", F.array_join(F.slice("g", 1, most_groups), ",").alias("groups"), F.size("g").alias("n_groups"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that links (a, b) reach.

    Every round takes the smallest label around each node and then the label of
    that label, until nothing changes.
    """
    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("around"))
        step = labels.join(around, labels["node"] == around["a"]).select("node", F.col("root").alias("old"), F.least("root", "around").alias("root"))
        jump = step.alias("s").join(step.select(F.col("node").alias("at"), F.col("root").alias("further")), F.col("s.root") == F.col("at"), "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
        jump = kept(jump)
        labels = jump.select("node", "root")
        if jump.where("root <> old").isEmpty():
            return labels


def removal(edges: DataFrame, group: str, at: int) -> DataFrame:
    """What taking a group away revokes, as rows of two sides (side, name, at): every member below it loses the group and
    all above it. Readers join the sides; ``tombstones`` writes them out as pairs."""
    pairs = closure(edges)
    below = pairs.where(F.col("ancestor") == group).select(F.lit("member").alias("side"), F.col("member").alias("name"))
    above = pairs.where(F.col("member") == group).select(F.lit("lost").alias("side"), F.col("ancestor").alias("name"))
    own = edges.sparkSession.createDataFrame([("lost", group)], "side string, name string")
    return below.unionByName(above).unionByName(own).withColumn("at", F.lit(at).cast("long"))


def tombstones(edges: DataFrame, group: str, at: int) -> DataFrame:
    """The same as pairs (principal, lost, at): every member below it times the group and all above it."""
    sides = kept(removal(edges, group, at))
    members = sides.where("side = 'member'").select(F.col("name").alias("principal"), "at")
    return members.join(sides.where("side = 'lost'").select(F.col("name").alias("lost"), "at"), "at").select("principal", "lost", "at")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed and changed keys of two directory snapshots."""
    b, a = before.select(F.col(key).alias("k"), F.col(value).alias("old")), after.select(F.col(key).alias("k2"), F.col(value).alias("new"))
    rows = b.join(a, b["k"] == a["k2"], "full_outer")
    change = F.when(F.col("k").isNull(), "added").when(F.col("k2").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return rows.select(F.coalesce("k", "k2").alias(key), change.alias("change")).where("change IS NOT NULL")


def acl_diff(rows: DataFrame) -> DataFrame:
    """Principals that a record lost and won between prior and current; losing any is a tightening."""
    return rows.withColumn("removed", F.array_sort(F.array_except("prior", "current"))).withColumn("added", F.array_sort(F.array_except("current", "prior"))).withColumn("tightened", F.size("removed") > 0)


def fidelity(pairs: DataFrame, granted: DataFrame, truth: DataFrame, users: DataFrame) -> DataFrame:
    """Verdict of every audited (user, record) pair, and why one that the source lets read is hidden.

    granted: pairs that are let in here; truth: pairs that the source lets read;
    users: user, federated, view_all. Hidden pairs of users without a federated
    identity come from that, of those with a right to view all from that, the
    rest from sharing that is not modelled. Audited pairs that neither side
    grants are true denials.
    """
    mark = lambda df, **k: df.select("user", "record", *[F.lit(k.get(c, False)).alias(c) for c in ("g", "t", "p")])
    known = "user IS NOT NULL AND record IS NOT NULL"
    return judged(mark(pairs, p=True).unionByName(mark(granted.where(known), g=True)).unionByName(mark(truth.where(known), t=True)), users)


def judged(marks: DataFrame, users: DataFrame) -> DataFrame:
    """The same of marks (user, record, g: let in here, t: the source lets it be read), by one grouping: of all pairs, or
    of those with a mark p (audited) where there is such a column. Only hidden pairs are looked up among the users."""
    rows = marks.groupBy("user", "record").agg(*[F.max(c).alias(c) for c in marks.columns if c not in ("user", "record")])
    if "p" in marks.columns:
        rows = rows.where("p")
    g, t = F.col("g"), F.col("t")
    verdict = F.when(g & t, "match_grant").when(~g & ~t, "match_deny").when(t, "over_hide").otherwise("under_hide")
    rows = rows.select("user", "record", verdict.alias("verdict"))
    cause = F.when(~F.coalesce("federated", F.lit(False)), "unmapped_identity").when(F.col("view_all"), "view_all").otherwise("non_floor")
    hidden = rows.where("verdict = 'over_hide'").join(users, "user", "left").select("user", "record", "verdict", cause.alias("cause"))
    return rows.where("verdict <> 'over_hide'").withColumn("cause", F.lit("none")).unionByName(hidden)
