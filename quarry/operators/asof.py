"""As-of join: for each probe (key, time) the last version of its key that began by then.

One sorted pass finds them: probes and versions of a key stand in one order of
time, and each probe takes the last version before it. A key may hold any share
of the rows, so time is cut into slices of about equal numbers of rows and the
pass is made within each slice of a key; what holds at a slice's start is the
last version of the slices before it, of which there is one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices of time.
SLICES = 64


def asof_join(probes: DataFrame, versions: DataFrame, keys: list[str], time: str, begins: str, take: list[str], tie: str | None = None, slices: int = SLICES) -> DataFrame:
    """Probes with the columns ``take`` of the last version whose ``begins`` is not after ``time``; null where there is none.

    Of versions that begin at once, the one with the greater ``tie`` holds (or any of them, without a tie).
    Null times and keys match nothing. Every probe is one row of the result.
    """
    order = [F.col(begins), F.col(tie)] if tie else [F.col(begins)]
    usable = versions.where(F.col(begins).isNotNull())
    for k in keys:
        usable = usable.where(F.col(k).isNotNull())
    cuts = sorted(set(probes.approxQuantile(time, [i / slices for i in range(1, slices)], 0.005))) if slices > 1 else []
    slice_of = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(c))) if cuts else F.lit(0)
    payload = F.struct(*(F.col(c).alias(c) for c in take), F.lit(True).alias("_held"))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    v = usable.select(*own, slice_of(begins).alias("_slice"), F.col(begins).cast("double").alias("_at"), F.struct(*order).alias("_order"), payload.alias("_v"))
    p = probes.withColumn("_slice", slice_of(time))

    # what holds at the start of each slice that has probes
    last = v.groupBy(*ks, "_slice").agg(F.max_by("_v", "_order").alias("_v"))
    asked = p.select(*own, "_slice").distinct()
    before = Window.partitionBy(*ks).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(asked.withColumn("_asked", F.lit(True)), [*ks, "_slice"], "full_outer").withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where("_asked AND _v IS NOT NULL")

    probe = F.struct(*probes.columns)
    none = F.lit(None)
    rows = (
        carried.select(*ks, "_slice", none.cast("double").alias("_at"), F.lit(0).alias("_kind"), none.cast(v.schema["_order"].dataType).alias("_order"), "_v", none.cast(probes.schema).alias("_p"))
        .unionByName(v.select(*ks, "_slice", "_at", F.lit(0).alias("_kind"), "_order", "_v", none.cast(probes.schema).alias("_p")))
        .unionByName(p.select(*own, "_slice", F.col(time).cast("double").alias("_at"), F.lit(1).alias("_kind"), none.cast(v.schema["_order"].dataType).alias("_order"), none.cast(v.schema["_v"].dataType).alias("_v"), probe.alias("_p")))
    )
    so_far = Window.partitionBy(*ks, "_slice").orderBy(F.asc_nulls_first("_at"), "_kind", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(so_far)).where("_kind = 1")
    known = F.col(f"_p.{time}").isNotNull()
    for k in keys:
        known = known & F.col(f"_p.{k}").isNotNull()
    return found.select("_p.*", *(F.when(known, F.col(f"_v.{c}")).alias(c) for c in take))
