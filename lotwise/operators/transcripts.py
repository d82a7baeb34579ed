"""Ordered event logs of sessions: tails, runs, separators and running text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MOST_STEP
from .spread import previous, running_sum

STEPS = ("reasoning", "tool", "error")


def _before(rows: DataFrame, session: str, order: Sequence[str], value: Column, name: str, spread: bool) -> DataFrame:
    """The last value that isn't null before each row of its session: in one window a session, or over ranges (``spread``)."""
    if spread:
        return previous(rows, [session], order, value, name)
    return rows.withColumn(name, F.last(value, True).over(Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))


def _so_far(rows: DataFrame, session: str, order: Sequence[str], amount: Column, name: str, spread: bool) -> DataFrame:
    """The sum of an amount over the rows of a session up to each of them."""
    if spread:
        return running_sum(rows, [session], order, amount, name)
    return rows.withColumn(name, F.sum(amount).over(Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def last_turns(turns: DataFrame, n: int = 24, session: str = "session", order: str = "turn", content: str = "content") -> DataFrame:
    """The last n turns of each session that aren't blank."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.filter(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"\s+", "") != "").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def merged_runs(events: DataFrame, kind: Column, session: str = "session", order: str = "seq", content: str = "content", merge: str = "reasoning", sep: str = "", spread: bool = False) -> DataFrame:
    """Steps of a session: fragments of the kind ``merge`` with no other step between them are one, every other step stands
    alone. Prose and status are no steps, so they neither count nor break a run. With ``spread`` a session is many tasks, else one."""
    steps = _before(events.withColumn("kind", kind).filter(F.col("kind").isin(*STEPS)), session, [order], F.col("kind"), "__before", spread)
    start = ~((F.col("kind") == merge) & F.coalesce(F.col("__before") == merge, F.lit(False)))
    runs = _so_far(steps, session, [order], start.cast("bigint"), "step", spread)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content]), sep)
    return runs.groupBy(session, "step").agg(F.min("kind").alias("kind"), F.count("*").alias("n"), F.min(order).alias("first"), text.alias("content"))


def separated(events: DataFrame, session: str = "session", order: str = "seq", kind: str = "kind", content: str = "content", prose: str = "message", quiet: str = "status", spread: bool = False) -> DataFrame:
    """Prose with a blank line before it where something else than prose came before; quiet events don't count. With ``spread`` a session is many tasks."""
    seen = _before(events.filter(F.col(kind) != quiet), session, [order], F.col(kind), "__before", spread)
    return seen.filter(F.col(kind) == prose).withColumn("piece", F.concat(F.when(F.coalesce(F.col("__before") != prose, F.lit(False)), F.lit("\n\n")).otherwise(F.lit("")), content)).drop("__before")


def running_text(pieces: DataFrame, session: str = "session", order: str = "seq", piece: str = "piece") -> DataFrame:
    """All text of a session up to each of its pieces. The result is quadratic in a session by what it is; ``so_far_length``
    is the linear form of it."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("so_far", F.array_join(F.collect_list(piece).over(w), ""))


def so_far_length(pieces: DataFrame, session: str = "session", order: str = "seq", piece: str = "piece") -> DataFrame:
    """The length of the text of a session up to each of its pieces."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("length_so_far", F.sum(F.length(piece)).over(w))


def recorded_turns(events: DataFrame, turn: Sequence[str] = ("session", "turn"), order: str = "seq", kind: str = "kind", content: str = "content", at: str = "at") -> DataFrame:
    """What a turn's reader saw: ``content`` (its prose, trimmed), ``tool_count``, and ``think_ms`` (from its first event to its
    last). ``at`` is in milliseconds."""
    rows = events.withColumn("__turn", F.struct(*turn))
    pieces = separated(rows, "__turn", order, kind, content)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"]), "")
    prose = pieces.groupBy(*turn).agg(F.regexp_replace(text, r"^\s+|\s+$", "").alias("content"))
    counts = events.groupBy(*turn).agg(F.count_if(F.col(kind) == "tool").alias("tool_count"), (F.max(at) - F.min(at)).alias("think_ms"))
    return counts.join(prose, list(turn), "left").withColumn("content", F.coalesce("content", F.lit("")))


def history(turns: DataFrame, session: str = "session", order: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """Earlier turns as a transcript: whole contents, each behind who said it, with a blank line between them."""
    line = F.concat(F.when(F.col(role) == "user", F.lit("User: ")).otherwise(F.lit("Assistant: ")), F.coalesce(F.col(content), F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n\n")
    return turns.groupBy(session).agg(joined.alias("history"), F.count("*").alias("turns"))


def action_text(name: Column, description: Column, keys: Column, values: Column, example: Column) -> Column:
    """One action for a prompt: heading, description, its parameters and an example of a proposal."""
    lines = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.concat(F.lit("  - "), p["k"], F.lit(": "), p["v"]))
    parts = F.concat(F.array(F.concat(F.lit("### "), name), description), F.when(F.size(keys) > 0, F.concat(F.array(F.lit("Parameters:")), lines)).otherwise(F.array().cast("array<string>")), F.array_compact(F.array(F.when(example != "", F.concat(F.lit("Example: <act>"), example, F.lit("</act>"))))), F.array(F.lit("")))
    return F.array_join(parts, "\n")


def prompt_text(context: Column, actions: Column, conversation: Column, message: Column) -> Column:
    """A prompt's envelope: the page, the actions, the conversation if there is one, and the message."""
    part = lambda tag, text: F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>\n\n"))
    return F.concat(part("page_context", context), part("page_actions", actions), F.when(F.coalesce(conversation, F.lit("")) != "", part("conversation_so_far", conversation)).otherwise(F.lit("")), part("user_message", message))


def gave_up(polls: DataFrame, failed: Column, key: str, order: str, most: int) -> DataFrame:
    """Where each poller stops: its ``most``-th failure in a row."""
    w = Window.partitionBy(key).orderBy(order)
    runs = polls.withColumn("__bad", failed).withColumn("__run", F.sum((~F.col("__bad")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = runs.filter("__bad").withColumn("__nth", F.row_number().over(Window.partitionBy(key, "__run").orderBy(order)))
    return nth.filter(F.col("__nth") >= most).groupBy(key).agg(F.min(order).alias("gave_up"))


def framed(kind: Column, content: Column) -> Column:
    """An event as a server-sent frame."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), content.alias("content"))), F.lit("\n\n"))


def unframed(frames: DataFrame, frame: str, *keep: str) -> DataFrame:
    """Events of frames; lines that aren't data and data that can't be read are skipped."""
    lines = frames.select(*keep, F.explode(F.split(F.col(frame), "\n")).alias("line")).filter(F.col("line").startswith("data: "))
    got = lines.select(*keep, F.from_json(F.substring(F.col("line"), F.lit(7), F.length("line")), "type string, content string").alias("e"))
    return got.filter("e.type is not null").select(*keep, F.col("e.type").alias("kind"), F.col("e.content").alias("content"))


#: What a failed turn without a reason says, what one that ended well says, and the most characters of a reason.
NO_REASON, COMPLETE, MOST_REASON = "The assistant could not finish this turn.", "complete", 1000


def mapped_events(events: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """Raw events (``kind``, ``tool_id``, ``content``, ``failed``, ``subtype``) as the reader sees them, by the rules of ``streaming.acts.TurnMapper``: fragments
    that say something as they come, a full text, trimmed, only where no such fragment came before it, a tool once per id, the end as status or as an error
    with its reason (one that only repeats the subtype is none). Events of other kinds are left out."""
    kind, content = F.col("kind"), F.coalesce("content", F.lit(""))
    plain = F.regexp_replace(content, r"(?U)^\s+|\s+$", "")
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fragments = F.coalesce(F.max(((kind == "text_delta") & (content != "")).cast("int")).over(w), F.lit(0)) > 0
    tools = Window.partitionBy(session, "kind", "tool_id").orderBy(order)
    seen = events.withColumn("__fragments", fragments).withColumn("__nth", F.row_number().over(tools))
    kept = F.when(kind.isin("text_delta", "thinking_delta"), content != "").when(kind == "text_full", ~F.col("__fragments") & (plain != "")).when(kind == "tool", F.col("__nth") == 1).otherwise(kind == "result")
    failed = F.coalesce("failed", F.lit(False))
    reason = F.when((plain == "") | plain.eqNullSafe(F.col("subtype")), NO_REASON).otherwise(F.substring(plain, 1, MOST_REASON))
    what = F.when(kind.isin("text_delta", "text_full"), "text").when(kind == "thinking_delta", "reasoning").when(kind == "tool", "tool").otherwise(F.when(failed, "error").otherwise("status"))
    says = F.when(kind == "text_full", plain).when(kind == "tool", F.substring(content, 1, MOST_STEP)).when(kind == "result", F.when(failed, reason).otherwise(COMPLETE)).otherwise(content)
    return seen.filter(F.coalesce(kept, F.lit(False))).select(*(says.alias("content") if c == "content" else what.alias("kind") if c == "kind" else F.col(c) for c in events.columns))


#: A tag of up to nine characters, nine characters that can't be one any more, plain text, or an open end.
TOKENS = r"<[^>]{0,7}>|<[^>]{8}|[^<]+|<[^>]*$"


def split_actions(events: DataFrame, session: str = "session", order: str = "seq", kind: str = "kind", content: str = "content", spread: bool = False) -> DataFrame:
    """Text events split into prose (``message``) and proposed actions (``action``) at their tags, in batch.

    The text between two other events is one run, so its chunks don't matter; whether an action is open outlasts the run.
    Rows: session, ``run``, ``piece``, kind and content. With ``spread`` a session is many tasks, and a run one row."""
    runs = _so_far(events, session, [order], (F.col(kind) != "text").cast("bigint"), "run", spread).filter(F.col(kind) == "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content]), "")
    tokens = runs.groupBy(session, "run").agg(text.alias("text")).select(session, "run", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)" + TOKENS), F.lit(0))).alias("at", "token"))
    tag = F.when(F.lower("token") == "<act>", F.lit("action")).when(F.lower("token") == "</act>", F.lit("message"))
    tagged = _before(tokens.withColumn("tag", tag), session, ["run", "at"], F.col("tag"), "__before", spread)
    marked = _so_far(tagged, session, ["run", "at"], F.col("tag").isNotNull().cast("bigint"), "piece", spread).withColumn("state", F.coalesce("tag", "__before", F.lit("message")))
    plain = marked.filter("tag is null").groupBy(session, "run", "piece", F.col("state").alias("kind"))
    return plain.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), "").alias("content")).filter("content <> ''")
