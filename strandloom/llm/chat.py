"""Chat formatting: event-sourced reconstruction of conversations, rendered with a reversible template.

Logs are partitioned by conversation and sorted by sequence; streamed deltas, edits and regenerations are folded into final
messages, which are then rendered. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What may not stand in a text as it is: an opening bracket, any backslashes, and the rest of a control string.
CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\]|\|)"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\]|\|)"


def escape(text: Column) -> Column:
    """Put one backslash after the bracket of each control string. Undone by unescape(), whatever the text holds."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role stands on the line that opens a turn, so its line feeds and backslashes are written out."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of an event log (conv_id, message, seq, kind, role, text).

    kind: `message` opens a message, `delta` appends to it, `edit` puts a new text in its place, `regenerate` starts it anew.
    A message is its last opening, edit or regeneration followed by the deltas after it, by (seq, role, text); rows that repeat
    are each applied. Its role is the last one that is told: deltas mostly carry none. Nulls: a null text is empty, a null kind is a `message`, a null seq comes first; a null conv_id is a
    conversation of its own. A message of deltas alone is their concatenation. Returns (conv_id, message, role, text).
    """
    event = F.struct(
        F.col("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.col("role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    resets = F.transform(
        "log", lambda x, i: F.when(x["kind"] != "delta", i + F.lit(1)).otherwise(F.lit(1))
    )
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda x: x.isNotNull())
    live = F.slice("log", F.array_max(resets), F.size("log"))
    return log.select(
        "conv_id",
        "message",
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation of messages (conv_id, message, role, text), in the order of (message, role, text).

    Returns conv_id, formatted, loss_mask array<boolean> (one flag a turn: is its text trained on), loss_spans
    array<struct<start,length>> (code points of formatted, escaped). Messages that repeat are each rendered. Nulls: role and
    text count as empty; a null conv_id is a conversation. An empty table gives no rows; other columns are left out.
    """
    order = Window.partitionBy("conv_id").orderBy("message", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turn = (
        messages.select(
            "conv_id",
            "message",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")))
        .withColumn("body", escape(F.col("text")))
        .withColumn("loss", F.col("role") == "assistant")
        .withColumn("length", F.length("head") + F.length("body") + F.lit(len(CLOSE)))
        .withColumn("begin", F.coalesce(F.sum("length").over(order), F.lit(0)) + F.length("head"))
    )
    piece = F.struct("begin", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "loss", F.length("body").cast("long").alias("length"))
    all_turns = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return all_turns.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("p", lambda x: x["loss"]).alias("loss_mask"),
        F.transform(
            F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["begin"].alias("start"), x["length"].alias("length"))
        ).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns (role, text, loss) parsed from the rendered string alone: conv_id, formatted, turns."""
    pieces = F.slice(F.split("formatted", F.lit(r"<\|im_start\|>")), 2, 1 << 30)

    def parsed(x: Column, i: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(CLOSE))
        return F.struct(
            unescape_role(role).alias("role"), unescape(body).alias("text"), F.get("loss_mask", i).alias("loss")
        )

    return rendered.select("conv_id", "formatted", F.transform(pieces, parsed).alias("turns"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    log = rows.unionByName(probe).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    # every row of this table opens a message of its own, also where a turn repeats
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "role", "text"))
    back = read_back(render(fold_events(log.withColumn("message", nth))))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0 from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\]|\|)', '\1\\\2\3', 'g') as body,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(<|\[)(\\*)(/?s>|/?INST\]|\|)', '\1\\\2\3', 'g') as head
  from r
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(12 + length(head) + 1 + length(body) + 11) as bigint) as formatted_chars
from e group by conv_id
"""
