"""Chat formatting from an event log, with DataFrame functions only.

A log row is (conv_id, message_no, seq, event, role, text). Events of a message are sorted by
seq and folded: `message` and `edit` set its text, `regenerate` clears it, `delta` appends to
it. Messages are then rendered by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: "### role:\n" text "\n</turn>\n". A control string in a text, with any
#: backslashes before it, gets one backslash more; markers have none.
END = "</turn>"
CONTROL = r"(\\*)(### [A-Za-z0-9_.*%+-]*:|</turn>)"
ESCAPED = r"\\(\\*)(### [A-Za-z0-9_.*%+-]*:|</turn>)"
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """The text with its control strings marked; empty stays empty, null null."""
    return F.regexp_replace(text, CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    """What escape was given."""
    return F.regexp_replace(text, ESCAPED, "$1$2")


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, message_no, role, text): the final messages.

    The state after the last event that sets the text needs only the deltas behind it, so the
    fold is one slice and one join of strings however long the log is. The last role that is
    not null counts. Null texts are empty; ties in seq are ordered by event, role and text.
    An unknown event changes nothing. A message without an event that survives is empty.
    """
    event = F.struct("seq", "event", "role", F.coalesce("text", F.lit("")).alias("text"))
    held = log.groupBy("conv_id", "message_no").agg(F.array_sort(F.collect_list(event)).alias("_e"))
    reset = F.array_max(F.transform("_e", lambda e, k: F.when(e["event"].isin(*RESETS), k + 1).otherwise(F.lit(0))))
    held = held.withColumn("_at", reset)
    base = F.when((F.col("_at") > 0) & (F.element_at("_e", F.greatest(F.col("_at"), F.lit(1)))["event"] != "regenerate"), F.element_at("_e", F.greatest(F.col("_at"), F.lit(1)))["text"]).otherwise(F.lit(""))
    tail = F.filter(F.slice("_e", F.col("_at") + 1, F.size("_e")), lambda e: e["event"] == "delta")
    roles = F.filter(F.transform("_e", lambda e: e["role"]), lambda r: r.isNotNull())
    return held.select(
        "conv_id",
        "message_no",
        F.when(F.size(roles) > 0, F.element_at(roles, F.greatest(F.size(roles), F.lit(1)))).otherwise(F.lit("")).alias("role"),
        F.concat(base, F.array_join(F.transform(tail, lambda e: e["text"]), "")).alias("text"),
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask): one row per conversation.

    loss_mask lists (start, length) in code points of formatted, one span for the escaped text
    of each message of role `learn`, in order. Places are running sums of lengths, so the work
    is in proportion to the turns. A conversation without messages has no row.
    """
    header = F.concat(F.lit("### "), F.url_encode("role"), F.lit(":\n"))
    turn = messages.select("conv_id", "message_no", (F.col("role") == learn).alias("_learn"), header.alias("_head"), escape(F.col("text")).alias("_body"))
    turn = turn.withColumn("_piece", F.concat("_head", "_body", F.lit(f"\n{END}\n")))
    upto = Window.partitionBy("conv_id").orderBy("message_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("_piece")).over(upto), F.lit(0).cast("long"))
    turn = turn.withColumn("_at", at)
    span = F.struct((F.col("_at") + F.length("_head")).cast("long").alias("start"), F.length("_body").cast("long").alias("length"))
    held = turn.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_piece").alias("piece")))).alias("_t"),
        F.array_sort(F.collect_list(F.when(F.col("_learn"), span))).alias("loss_mask"),
    )
    return held.select("conv_id", F.array_join(F.transform("_t", lambda t: t["piece"]), "").alias("formatted"), "loss_mask")


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars), read from the rendered string and its mask alone.

    Turns are cut at their marks. A masked span is cut from the turn that it starts in, found by
    one sort of turns and spans by place; so no span walks the whole string.
    """
    mark = len(END) + 1
    rows = formatted.select("conv_id", "loss_mask", F.length("formatted").cast("long").alias("_chars"), F.posexplode(F.filter(F.split("formatted", r"(?<!\\)</turn>\n", -1), lambda p: p != "")).alias("_n", "_piece"))
    before = Window.partitionBy("conv_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("_piece") + mark).over(before), F.lit(0).cast("long")))
    # A row for each turn and, on the first turn's row, one for each span.
    spans = F.when(F.col("_n") == 0, F.transform("loss_mask", lambda s: F.struct(s["start"].alias("at"), s["length"].alias("n"), F.lit(None).cast("string").alias("piece"))))
    none = F.array().cast("array<struct<at:bigint,n:bigint,piece:string>>")
    turn = F.array(F.struct(F.col("_at").alias("at"), F.lit(None).cast("long").alias("n"), F.col("_piece").alias("piece")))
    units = rows.select("conv_id", "_chars", F.explode(F.concat(turn, F.coalesce(spans, none))).alias("_u")).select("conv_id", "_chars", "_u.*")
    held = Window.partitionBy("conv_id").orderBy("at", F.col("n").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.withColumn("_turn", F.last(F.when(F.col("n").isNull(), F.struct("at", "piece")), ignorenulls=True).over(held))
    cut = F.substring(F.col("_turn.piece"), (F.col("at") - F.col("_turn.at") + 1).cast("int"), F.col("n").cast("int"))
    role = F.url_decode(F.regexp_extract("piece", r"^### ([^\n]*):\n", 1))
    body = unescape(F.regexp_extract("piece", r"(?s)^### [^\n]*:\n(.*)\n$", 1))
    found = units.select("conv_id", "_chars", "at", F.when(F.col("n").isNull(), F.struct(role.alias("role"), body.alias("text"))).alias("_read"), F.when(F.col("n").isNotNull(), unescape(cut)).alias("_loss"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("v"))))), lambda x: x["v"])
    return found.groupBy("conv_id").agg(ordered("_read").alias("turns"), F.array_join(ordered("_loss"), "").alias("loss_text"), F.first("_chars").alias("formatted_chars"))


def format_log(log: DataFrame, learn: str = "assistant") -> DataFrame:
    """The log's final messages, rendered; nulls, ties and empty logs as in fold_events and render."""
    return render(fold_events(log), learn)


def log_of_rows(rows: DataFrame, chunk: int = 400) -> DataFrame:
    """An event log that replays rows (conv_id, turn, role, text) as a server would have logged them.

    Each row is one message, also where turns repeat (then ordered by role and text; null turns
    come last). Assistant messages are a first attempt that is given up, `regenerate`, and the
    text in deltas of `chunk` code points; others are a draft that an `edit` replaces.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message_no", F.row_number().over(order))
    made = lambda name, text: F.struct(F.lit(name).alias("event"), text.alias("text"))
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{int(chunk)}}}"), F.lit(0))
    streamed = F.concat(
        F.array(made("delta", F.substring("text", 1, 80)), made("regenerate", F.lit(None).cast("string"))),
        F.transform(parts, lambda p: made("delta", p)),
    )
    typed = F.array(made("message", F.concat(F.lit("draft: "), F.substring("text", 1, 80))), made("edit", F.col("text")))
    events = F.when(F.col("role") == "assistant", streamed).otherwise(typed)
    return rows.select("conv_id", "message_no", "role", F.posexplode(events).alias("seq", "_e")).select("conv_id", "message_no", "seq", "_e.event", "role", "_e.text")
