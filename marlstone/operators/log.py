"""The session event log and its projections; the log is append-only and every projection is recomputed from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "session_id string, id string, seq long, type string, ts string, text string, kind string, chunk_ids array<string>, paths array<string>, "
    "tool_name string, tool_args string, tool_use_id string, packed_tokens long, full_tokens long, completion_tokens long, loop_attempts int, "
    "stall_count int, pack_mode string, replace_ids array<string>, replace_generation int, placeholders map<string,string>, cleared_ids array<string>, "
    "tokens_freed long, kept int, extra string, v int"
)
INDEXED = ("user", "assistant", "tool_use", "tool_result", "system", "compact")


def number_events(events: DataFrame) -> DataFrame:
    """``id`` (``e`` and four digits, more from 10,000 on) by ``seq`` within the session, and ``generation``: compactions up to the event."""
    order = Window.partitionBy("session_id").orderBy("seq")
    n = F.row_number().over(order)
    generation = F.sum((F.col("type") == "compact").cast("int")).over(order)
    return events.withColumn("id", F.concat(F.lit("e"), F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")))).withColumn("generation", generation)


def derive_messages(events: DataFrame) -> DataFrame:
    """``session_id, position, id, role, text``: what a model would see.

    Events that a compaction replaces are gone; of the live system events only the latest stays and comes first; a compaction reads as a
    system message; cleared tool results read as their placeholders, of which the latest wins.
    """
    shadowed = events.where("type = 'compact'").select("session_id", F.explode("replace_ids").alias("id")).distinct()
    live = events.join(shadowed, ["session_id", "id"], "left_anti")
    marks = live.where("type = 'clear'").select("session_id", "seq", F.explode("placeholders").alias("id", "mark"))
    marks = marks.groupBy("session_id", "id").agg(F.max_by("mark", "seq").alias("mark"))
    rows = live.where(F.col("type").isin(*INDEXED)).join(marks, ["session_id", "id"], "left")
    last = F.max(F.when(F.col("type") == "system", F.col("seq"))).over(Window.partitionBy("session_id"))
    rows = rows.withColumn("_last", last).where((F.col("type") != "system") | (F.col("seq") == F.col("_last")))
    role = F.when(F.col("type").isin("system", "compact"), "system").when(F.col("type") == "tool_result", "tool").when(F.col("type") == "tool_use", "assistant").otherwise(F.col("type"))
    text = F.when(F.col("type") == "tool_result", F.coalesce("mark", "text")).otherwise(F.col("text"))
    order = Window.partitionBy("session_id").orderBy((F.col("type") == "system").desc(), "seq")
    return rows.select("session_id", (F.row_number().over(order) - 1).alias("position"), "id", role.alias("role"), text.alias("text"))


def derive_turns(messages: DataFrame) -> DataFrame:
    """``session_id, turn, user_text, answer, tools``: each user message with the last assistant text and the tool results before the next."""
    order = Window.partitionBy("session_id").orderBy("position")
    rows = messages.withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(order)).where("turn > 0")
    return rows.groupBy("session_id", "turn").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_text"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("position"))).alias("answer"),
        F.count_if(F.col("role") == "tool").alias("tools"),
    )


def dialogue_pairs(turns: DataFrame, session: str, seq: str, role: str, text: str) -> DataFrame:
    """``session, seq, user_text, assistant_text``: user rows with the answer that follows at once among user and assistant rows, else null."""
    order = Window.partitionBy(session).orderBy(seq)
    rows = turns.where(F.col(role).isin("user", "assistant"))
    rows = rows.withColumn("_r", F.lead(role).over(order)).withColumn("_t", F.lead(text).over(order))
    return rows.where(F.col(role) == "user").select(session, seq, F.col(text).alias("user_text"), F.when(F.col("_r") == "assistant", F.col("_t")).alias("assistant_text"))


def latest(events: DataFrame, kind: str, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """The last event of a type in each session: ``session, seq, text``."""
    return events.where(F.col("type") == kind).groupBy(session).agg(F.max(seq).alias(seq), F.max_by("text", seq).alias("text"))


def beyond_last(events: DataFrame, keep: int, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """All rows but the newest ``keep`` of each session."""
    order = Window.partitionBy(session).orderBy(F.col(seq).desc())
    return events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > keep).drop("_n")


def compact_range(events: DataFrame, keep: int, session: str = "session_id", seq: str = "seq", role: str = "role") -> DataFrame:
    """Rows before the ``keep``-th last user row: what a compaction that keeps so many exchanges would replace."""
    order = Window.partitionBy(session).orderBy(F.col(seq).desc())
    users = events.where(F.col(role) == "user").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep)
    first = users.groupBy(session).agg(F.min(seq).alias("_first"))
    return events.join(first, session).where(F.col(seq) < F.col("_first")).drop("_first")


def clear_tool_results(events: DataFrame, keep: int = 1, least_chars: int = 80) -> DataFrame:
    """``session_id, id, placeholder``: tool results of ``least_chars`` or more that a clearing would replace, all but the newest ``keep``."""
    dumps = events.where((F.col("type") == "tool_result") & (F.length("text") >= least_chars))
    old = beyond_last(dumps, keep)
    note = F.concat(F.lit("[cleared "), F.coalesce("tool_name", F.lit("tool")), F.lit(": "), F.length("text").cast("string"), F.lit(" chars]"))
    return old.select("session_id", "id", note.alias("placeholder"))


def session_cost(events: DataFrame, input_price: float = 3.0, output_price: float = 15.0) -> DataFrame:
    """Token sums, freed tokens, cleared results and dollars (prices a million tokens) of each session."""
    cleared = F.size(F.coalesce("cleared_ids", F.map_keys("placeholders"), F.array().cast("array<string>")))
    sums = events.groupBy("session_id").agg(
        F.coalesce(F.sum("packed_tokens"), F.lit(0)).alias("packed"),
        F.coalesce(F.sum("full_tokens"), F.lit(0)).alias("full"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion"),
        F.coalesce(F.sum(F.when(F.col("type") == "clear", F.col("tokens_freed"))), F.lit(0)).alias("freed"),
        F.sum(F.when(F.col("type") == "clear", cleared).otherwise(0)).alias("cleared"),
    )
    return sums.withColumn("dollars", F.round((F.col("packed") * input_price + F.col("completion") * output_price) / 1e6, 6))


def history_budget(rows: DataFrame, budget: int, session: str = "session_id", seq: str = "seq", tokens: str = "tokens") -> DataFrame:
    """From the newest back: ``fits`` while the running tokens stay in the budget, the first beyond is a ``stub``, older ones are gone."""
    order = Window.partitionBy(session).orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("used", F.sum(tokens).over(order))
    over = F.sum((F.col("used") > budget).cast("int")).over(order)
    return run.withColumn("_over", over).where("_over <= 1").withColumn("state", F.when(F.col("_over") == 0, "fits").otherwise("stub")).drop("_over")


def indexable_body(events: DataFrame) -> DataFrame:
    """``session_id, id, seq, body`` of the types that full-text search covers."""
    body = F.concat_ws(" ", "tool_name", "tool_args", "text")
    return events.where(F.col("type").isin(*INDEXED)).select("session_id", "id", "seq", body.alias("body"))


def extractive_summary(pairs: DataFrame, session: str = "session_id", seq: str = "seq", width: int = 160) -> DataFrame:
    """First sentences of the user rows, in order, as one line each."""
    first = F.substring(F.regexp_extract("user_text", r"^[^.!?\n]*[.!?]?", 0), 1, width)
    rows = pairs.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(seq), first.alias("s")))).alias("_l"))
    return rows.select(session, F.array_join(F.transform("_l", lambda s: s["s"]), "\n").alias("summary"))


def render(messages: DataFrame) -> Column:
    return F.concat_ws(": ", "role", "text")


def tool_pairs(events: DataFrame) -> DataFrame:
    """``session_id, result_id, use_id, tool_name``: each tool result with the use that it names, or the last use before it where it names none
    (null if there is none)."""
    order = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    is_use = F.col("type") == "tool_use"
    rows = events.where(F.col("type").isin("tool_use", "tool_result")).withColumn("_last", F.last(F.when(is_use, F.col("id")), ignorenulls=True).over(order))
    uses = rows.where(is_use).select("session_id", F.col("id").alias("use_id"), "tool_name")
    results = rows.where(~is_use).select("session_id", F.col("id").alias("result_id"), F.coalesce("tool_use_id", "_last").alias("use_id"))
    return results.join(uses, ["session_id", "use_id"], "left").select("session_id", "result_id", F.when(F.col("tool_name").isNotNull(), F.col("use_id")).alias("use_id"), "tool_name")


# The types of a typed log, its version, and the events of the log before it.
TYPES = ("user", "assistant", "tool_use", "tool_result", "system", "compact", "clear", "verify", "meta")
VERSION = 1
LEGACY = ("session_start", "turn", "compact", "clear_tool_results")


def log_kinds(rows: DataFrame, session: str = "session_id", place: str = "seq") -> DataFrame:
    """``session, legacy``: whether the first row that tells is of the older kind. ``rows``: ``type, v, event``; a log of no telling row isn't."""
    typed = F.col("type").isin(*TYPES) & (F.col("v") == VERSION)
    tells = F.when(F.coalesce(typed, F.lit(False)), False).when(F.col("event").isin(*LEGACY), True)
    return rows.groupBy(session).agg(F.coalesce(F.min_by(tells, F.when(tells.isNotNull(), F.col(place))), F.lit(False)).alias("legacy"))
