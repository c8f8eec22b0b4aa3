"""Chat formatting from an event log, by DataFrame functions alone.

An event log holds, per conversation and in order of ``seq``, what happened to
its messages: ``open`` (role), ``delta`` (a piece of text), ``edit`` (text that
replaces all so far), ``regenerate`` (starts over) and ``delete``. Folding
takes, for each message, the last event that set it anew and joins that event's
text and the deltas after it; messages stand in the order in which they were
opened. Rendering writes every message as

    ### <Role>:<newline><text></turn><newline>

in which the roles' names and the text are escaped reversibly, so no text can
begin or end a turn: ``\\`` becomes ``\\\\``, and ``##`` and ``</turn>`` get a
``\\`` behind their first character, so ``###`` stands nowhere in a text. The loss mask is a list of (start, length)
in code points of the formatted text, one for each assistant message; reading
back splits at the template's marks and unescapes.

Scale: events meet by (conversation, message) first, in an aggregate; the
order within a conversation comes from a window over messages, which streams
and spills; only rendered messages are gathered by conversation, since its one
output row holds them all. There is no Python on the way.

Cases: very long texts and conversations are written whole; a null text is
empty; a null role is written as an empty one; rows of
one conversation with one sequence number stand in the order of role and text,
and each counts; a null conversation id is a conversation of its own; an empty
table gives no rows; an event before its message's ``open`` still counts, and
a message never opened has an empty role; a conversation whose messages are
all deleted is not in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import table

HEAD, MIDDLE, END = "### ", ":\n", "</turn>\n"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("##"), F.lit("#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    """The inverse: after a backslash stands what it protects; a pair of them is one."""
    pairs = F.split(text, "\\\\\\\\", -1)  # at doubled backslashes, which single ones never touch
    return F.array_join(F.transform(pairs, lambda p: F.replace(F.replace(p, F.lit("#\\#"), F.lit("##")), F.lit("<\\/turn>"), F.lit("</turn>"))), "\\")


def name_of(role: Column) -> Column:
    """A role's name in the template: no mark, backslash or colon is left bare."""
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def role_of(name: Column) -> Column:
    pairs = F.split(name, "\\\\\\\\", -1)
    return F.array_join(F.transform(pairs, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\c"), F.lit(":")), F.lit("#\\#"), F.lit("##")), F.lit("<\\/turn>"), F.lit("</turn>"))), "\\")


def folded(events: DataFrame) -> DataFrame:
    """Final messages of an event log (conv_id, message, seq, kind, role, text)."""
    sets = F.col("kind").isin("open", "edit", "regenerate")
    message = events.groupBy("conv_id", "message").agg(
        F.min(F.when(F.col("kind") == "open", F.col("seq"))).alias("opened"),
        F.min("seq").alias("first_seq"),
        F.max(F.when(sets, F.col("seq"))).alias("reset"),
        F.max_by("kind", "seq").alias("last_kind"),
        F.max_by("role", F.when(F.col("kind") == "open", F.col("seq"))).alias("role"),
        F.collect_list(F.when(F.col("kind").isin("open", "edit", "delta"), F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("pieces"),
    )
    live = F.filter("pieces", lambda p: F.col("reset").isNull() | (p["seq"] >= F.col("reset")))
    text = F.array_join(F.transform(F.array_sort(live), lambda p: p["text"]), "")
    return message.where(F.col("last_kind") != "delete").select("conv_id", F.coalesce("opened", "first_seq").alias("place"), "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted text and loss mask of every conversation."""
    turn = F.concat(F.lit(HEAD), name_of(F.col("role")), F.lit(MIDDLE), escaped(F.col("text")), F.lit(END))
    lead = F.length(name_of(F.col("role"))) + len(HEAD) + len(MIDDLE)
    before = Window.partitionBy("conv_id").orderBy("place", "message").rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.select("conv_id", "place", "message", "role", turn.alias("turn"), lead.alias("lead")).withColumn("size", F.length("turn"))
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    mask = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.col("lead")).cast("long").alias("start"), (F.col("size") - F.col("lead") - len(END)).cast("long").alias("length")))
    turns = rows.groupBy("conv_id").agg(F.collect_list(F.struct("at", "message", "turn")).alias("turns"), F.array_sort(F.collect_list(mask)).alias("loss"))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform(F.array_sort("turns"), lambda t: t["turn"]), "").alias("formatted"), "loss")


def read_back(formatted: Column) -> Column:
    """The (role, text) of every turn, from a formatted text alone."""
    parts = F.split(formatted, "</turn>\n", -1)
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(turns, lambda t: F.struct(role_of(F.substring_index(F.substr(t, F.lit(len(HEAD) + 1)), MIDDLE, 1)).alias("role"), unescaped(F.substr(t, F.instr(t, MIDDLE) + len(MIDDLE))).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda m: unescaped(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def events_of(conversations: DataFrame) -> DataFrame:
    """Whole turns as the log of how they might have come about.

    Each is opened empty; a draft is begun and generated anew; the first half of
    its text streams in, is edited by mistake and edited back; the second half
    follows. Every third turn is preceded by one that is opened, begun and
    deleted. What the fold leaves are the turns.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("number"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    event = lambda message, k, kind, text: F.struct(message.alias("message"), (F.col("number") * 16 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    own = lambda k, kind, text: event(F.col("number"), k, kind, text)
    none = lambda k, kind, text: event(-F.col("number"), k, kind, text)
    kept = F.array(own(4, "open", F.lit("")), own(5, "delta", F.lit("I would say ")), own(6, "regenerate", F.lit(None).cast("string")), own(7, "delta", first), own(8, "edit", F.lit("</turn> ##")), own(9, "edit", first), own(10, "delta", second))
    dropped = F.array(none(1, "open", F.lit("")), none(2, "delta", F.lit("never mind")), none(3, "delete", F.lit(None).cast("string")))
    events = F.concat(kept, F.when(F.col("number") % 3 == 0, dropped).otherwise(F.slice(dropped, 1, 0)))
    return numbered.select("conv_id", "role", F.explode(events).alias("e")).select("conv_id", "e.message", "e.seq", "e.kind", "role", "e.text")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"), F.lit(said).alias("text")).select("conv_id", "t.turn", "t.role", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = rendered(folded(events_of(rows))).withColumn("turns", read_back(F.col("formatted"))).withColumn("under_loss", masked_text(F.col("formatted"), F.col("loss")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", "n_turns", F.sha2(digest, 256).alias("turns_sha256"), F.length("under_loss").cast("long").alias("loss_chars"), F.sha2("under_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The same by plain SQL; the escapes add one character for each backslash, "##" and "</turn>".
ORACLE_OP2 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS x,
             replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\c') AS r FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(r) + length(x) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
