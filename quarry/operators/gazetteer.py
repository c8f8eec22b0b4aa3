"""Surface forms in texts: an automaton over all forms, and forms that are nearly the same words.

Forms and texts are compared as words (lower-cased runs of letters and digits).
Up to ``SENT`` forms go to every task, whose automaton finds all of them in one
pass over a text; of more, the runs of words of a text that have as many words
as some form with that first word are joined with the forms by equality. Both
give the same rows.

Nearly the same are two sets of words whose Jaccard similarity is ``FUZZY`` or
more. Such sets share one of the first (1 - t) * size + 1 words in any fixed
order, so both sides file under so many of their words, the rarest first, and
meet there; common words bring nobody together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Forms that are sent to every task.
SENT = 200_000
#: Least similarity of words.
FUZZY = 0.6


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _automaton(forms: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for form in forms:
        automaton.add_word(f" {form} ", form)
    automaton.make_automaton()
    return automaton


def found_forms(texts: DataFrame, forms: DataFrame, sent: int = SENT) -> DataFrame:
    """(id, form, at): where forms (form) stand in texts (id, content), by the number of their first word from 0."""
    own = forms.select(F.array_join(words(F.col("form")), " ").alias("form")).where("form <> ''").distinct()
    spoken = texts.select("id", words(F.col("content")).alias("w")).where("size(w) > 0")
    known = [r["form"] for r in own.limit(sent + 1).collect()]
    if len(known) <= sent:
        if not known:
            return texts.sparkSession.createDataFrame([], f"id {texts.schema['id'].dataType.simpleString()}, form string, at int")
        load = texts.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(load.value)
            for batch in batches:
                rows: list[tuple[int, str, int]] = []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    at, place = 0, 0  # words before ``place``; ends come in order, so a text is counted through once
                    for end, form in automaton.iter(f" {text} "):
                        at += text.count(" ", place, end - 1) if end - 1 > place else 0
                        place = max(place, end - 1)
                        rows.append((k, form, at - form.count(" ")))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["id", "form", "at"])

        lines = spoken.select("id", F.array_join("w", " ").alias("s"))
        return lines.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, form string, at int")
    sized = own.withColumn("f", F.split("form", " ")).select("form", F.get("f", F.lit(0)).alias("first"), F.size("f").alias("n"))
    lengths = sized.select("first", "n").distinct()
    places = spoken.select("id", F.posexplode("w").alias("at", "first"), "w").join(lengths, "first")
    runs = places.where(F.col("at") + F.col("n") <= F.size("w")).select("id", "at", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("form"))
    return runs.join(own, "form").select("id", "form", "at")


def near_forms(mentions: DataFrame, forms: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(mention, form, score): different wordings whose sets of words are alike; each different one is compared once."""
    texts = {"mention": mentions.select(F.col("mention").alias("t")), "form": forms.select(F.col("form").alias("t"))}
    sets = {side: df.where("t IS NOT NULL").distinct().withColumn("w", F.array_distinct(words(F.col("t")))).where("size(w) > 0") for side, df in texts.items()}
    each = {side: df.select("t", F.explode("w").alias("g"), F.size("w").alias("n")) for side, df in sets.items()}
    often = each["mention"].unionByName(each["form"]).groupBy("g").agg(F.count("*").alias("df"))

    def filed(side: str) -> DataFrame:
        rank = Window.partitionBy("t").orderBy("df", "g")
        first = each[side].join(often, "g").withColumn("k", F.row_number().over(rank))
        return first.where(F.col("k") <= F.floor((1 - threshold) * F.col("n") + 1e-9) + 1).select(F.col("t").alias(side), "g")

    met = filed("mention").join(filed("form"), "g").select("mention", "form").distinct()
    rows = met.join(sets["mention"].select(F.col("t").alias("mention"), F.col("w").alias("mw")), "mention").join(sets["form"].select(F.col("t").alias("form"), F.col("w").alias("fw")), "form")
    both = F.size(F.array_intersect("mw", "fw"))
    score = both / (F.size("mw") + F.size("fw") - both)
    return rows.withColumn("score", score).where(F.col("score") >= threshold).select("mention", "form", F.round("score", 4).alias("score"))
