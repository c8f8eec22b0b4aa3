"""The fold kept up to date: only components that new evidence touches are folded again.

A store holds, in one table of files, every row of evidence with the component
it is in, the component of every node, and what the fold says of each component.
Rows are dealt to parts by a hash of their component (those of nodes by the
node). A batch of new evidence looks its nodes up, reads the components these
are in, folds them together with what is new, and writes only the files that
held rows of them; parts without any are neither read nor written. Components
of the store are those of all evidence, whatever the fold's rules let through,
so the fold of each is the same as within the whole.

Keys that fan out link nothing, so their leaves are kept by key, apart: a key
that a third of all refs hold does not make one component of them. A key that
reaches its third leaf is folded once more, without it.

One version of the file list holds all of a batch's changes, so a run that stops
has changed nothing, and a batch that comes again changes nothing either: rows
are known by their ids. Evidence is never taken away here; a rejection is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graph import components
from quarry.operators.resolve import STRONG_KINDS, Config, eligible, fold, leaves_of
from quarry.session import kept
from quarry.sources.files import Files

EVIDENCE = "id string, left_ref string, right_ref string, tier int, method string, key_kind string, key_value string, namespace string, polarity int"
ALIAS = "ref string, canonical string, confidence string, method string, evidence_count int, members long"
REVIEW = "reason string, subject string, members long"
#: kind: node (key: a node, other: its component), evidence, alias and review (key: a component), fanned (key: a key, other: a leaf).
STATE = "kind string, key string, other string, e struct<{}>, a struct<{}>, r struct<{}>".format(*(s.replace(" ", ":").replace(",:", ",") for s in (EVIDENCE, ALIAS, REVIEW)))
#: Parts that components are dealt to.
PARTS = 64


class Resolution:
    """The fold of all evidence so far, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, config: Config, parts: int = PARTS):
        self.files, self.config, self.parts = Files(spark, folder, STATE), config, parts

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _rows(self, kind: str, keys: DataFrame) -> DataFrame:
        """State of one kind with these keys (key), read from their parts alone."""
        parts = [r[0] for r in keys.select(self._part(F.col("key"))).distinct().collect()]  # self.parts at most
        return self.files.read(parts=parts).where(F.col("kind") == kind).join(keys.select("key").distinct(), "key", "left_semi")

    def add(self, evidence: DataFrame) -> list[str]:
        """Takes a batch of new evidence in; returns the files that were written anew."""
        columns = [c.split()[0] for c in EVIDENCE.split(", ")]
        new = kept(evidence.select(*columns).dropDuplicates(["id"]))
        # leaves of keys that fan out already are counted, and nothing else
        leaves = leaves_of(eligible(new, self.config)).select("id", "key", "leaf")
        fanned = kept(self._rows("fanned", leaves).select("key").distinct())
        known_leaves = leaves.join(fanned, "key", "left_semi")
        rest = kept(new.join(known_leaves.select("id"), "id", "left_anti"))
        ends = rest.select(F.explode(F.array("left_ref", "right_ref")).alias("key")).distinct()
        roots = kept(self._rows("node", ends).select(F.col("other").alias("key")).distinct())
        held = self._rows("evidence", roots).select("e.*")
        own = kept(held.unionByName(rest).dropDuplicates(["id"]))
        # keys with more than two leaves now leave the fold
        sized = leaves_of(eligible(own, self.config)).groupBy("key").agg(F.count_distinct("leaf").alias("n"), F.max("key_kind").alias("kind"))
        over = kept(sized.where((F.col("n") > 2) & ~F.col("kind").isin(*STRONG_KINDS)).select("key"))
        dropped = kept(leaves_of(eligible(own, self.config)).join(over, "key", "left_semi").select("id", "key", "leaf"))
        live = kept(own.join(dropped.select("id"), "id", "left_anti"))
        aliases, reviews = fold(live, self.config)
        pairs = live.select(F.least("left_ref", "right_ref").alias("a"), F.greatest("left_ref", "right_ref").alias("b"))
        at = kept(components(pairs).select("node", "root"))
        old_nodes = held.select(F.explode(F.array("left_ref", "right_ref")).alias("key")).distinct()
        drop = kept(roots.select(F.explode(F.array(*map(F.lit, ("evidence", "alias", "review")))).alias("kind"), "key").unionByName(old_nodes.select(F.lit("node").alias("kind"), "key")))
        fresh = [
            at.select(F.lit("node").alias("kind"), F.col("node").alias("key"), F.col("root").alias("other")),
            live.join(at, live["left_ref"] == at["node"]).select(F.lit("evidence").alias("kind"), F.col("root").alias("key"), F.struct(*columns).alias("e")),
            aliases.join(at, aliases["ref"] == at["node"]).select(F.lit("alias").alias("kind"), F.col("root").alias("key"), F.struct("ref", "canonical", "confidence", aliases["method"].alias("method"), F.col("evidence_count").cast("int").alias("evidence_count"), F.col("members").cast("long").alias("members")).alias("a")),
            reviews.join(at, reviews["subject"] == at["node"]).select(F.lit("review").alias("kind"), F.col("root").alias("key"), F.struct("reason", "subject", F.col("members").cast("long").alias("members")).alias("r")),
            known_leaves.select("key", "leaf").unionByName(dropped.select("key", "leaf")).distinct().select(F.lit("fanned").alias("kind"), "key", F.col("leaf").alias("other")),
        ]
        rows = fresh[0]
        for more in fresh[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        parts = [r[0] for r in drop.select(self._part(F.col("key"))).distinct().collect()]
        return self.files.rewrite(drop, ["kind", "key"], by=self._part(F.col("key")), parts=parts, more=rows.to(self.files.read(()).schema))

    def aliases(self) -> DataFrame:
        return self.files.read().where("kind = 'alias'").select("a.*")

    def reviews(self) -> DataFrame:
        """Reviews of components, and the keys that fan out with how many hold them."""
        state = self.files.read()
        fanned = state.where("kind = 'fanned'").groupBy("key").agg(F.count_distinct("other").alias("members")).select(F.lit("key_fan_out").alias("reason"), F.col("key").alias("subject"), "members")
        return state.where("kind = 'review'").select("r.*").unionByName(fanned)
