"""Erasure on files: only files that hold rows to be erased or altered are written anew.

The walk is that of ``knowledge.erasure``. What it removes and alters is
settled first, from the tables as they are, and written down; then each table
is rewritten in one version of its own, and the files of former versions go, so no
erased row is left on disk. Each table's step gives the same result when it
is repeated, so a run that stopped is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import postings
from quarry.operators.knowledge import erasure
from quarry.session import kept
from quarry.sources.files import Files

#: By table, its key and its name among what an erasure removes.
KEYS = {
    "episodes": ("episode_id", "episodes"),
    "actions": ("action_id", "actions"),
    "chunks": ("id", "chunks"),
    "facts": ("fact_id", "facts"),
    "evidence": ("evidence_id", "knowledge_evidence"),
    "items": ("knowledge_id", "items"),
    "quarantine": ("id", "quarantine"),
    "audit": ("id", "audit"),
    "media": ("id", "media"),
}


def erase_on_files(files: dict[str, Files], at: int, subject: str | None = None, entity: str | None = None, media: tuple[int, ...] = (), index: postings.Index | None = None) -> dict[str, list[str]]:
    """Erases a subject, an entity and media from the tables (as ``knowledge.erasure`` names them) and from the postings
    of the chunks (of tenant and content); returns by table the files that were written anew."""
    before = {name: f.read() for name, f in files.items()}
    removed, left = erasure(before, at, subject, entity, media)
    left["evidence"] = left["knowledge_evidence"]
    dead = removed["facts"].select(F.col("fact_id").alias("superseded_by"))
    support = removed["knowledge_evidence"].select("knowledge_id").distinct()
    retired = removed["knowledge_invalidated"].select(F.concat(F.lit("knowledge:"), F.col("knowledge_id").cast("string")).alias("document_id"))
    altered = {
        "facts": before["facts"].join(dead, "superseded_by", "left_semi").select("fact_id"),
        "items": before["items"].join(support, "knowledge_id", "left_semi").select("knowledge_id"),
        "chunks": before["chunks"].join(retired, "document_id", "left_semi").select("id"),
    }
    steps: dict[str, tuple[DataFrame, DataFrame | None]] = {}
    for name, (key, gone) in KEYS.items():
        keys = removed[gone].select(key) if name != "items" else altered["items"]
        fresh = None
        if name in altered:
            keys = keys.unionByName(altered[name])
            fresh = kept(left[name].join(altered[name].distinct(), key, "left_semi").select(*before[name].columns))
        steps[name] = kept(keys.distinct()), fresh
    gone_text = kept(removed["chunks"].select("tenant", "id", "content")) if index is not None else None
    touched = {}
    for name, (keys, fresh) in steps.items():
        if name in files:
            none = fresh is None or fresh.isEmpty()
            touched[name] = files[name].rewrite(keys, [KEYS[name][0]], more=None if none else fresh)
    if gone_text is not None:
        touched["postings"] = postings.erase(index, gone_text)
    return touched
