"""The same splitting of prose and actions over an unbounded stream, with state by session."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import MOST_STEP
from ..operators.transcripts import COMPLETE, MOST_REASON, NO_REASON, TOKENS

_TOKEN = re.compile(TOKENS, re.DOTALL)
_STATES = {"<act>": "action", "</act>": "message"}


class ActionSplitter:
    """Splits chunks of text; what can't be decided yet waits for the next chunk. ``state``: (kind, held content, open tag)."""

    def __init__(self, kind: str = "message", held: str = "", tail: str = ""):
        self.kind, self.held, self.tail = kind, held, tail

    @property
    def state(self) -> tuple[str, str, str]:
        return self.kind, self.held, self.tail

    def feed(self, chunk: str) -> list[tuple[str, str]]:
        """Prose of the chunk, and actions that end in it."""
        out, text, self.tail = [], self.tail + chunk, ""
        for m in _TOKEN.finditer(text):
            token = m.group()
            if token[0] == "<" and token[-1] != ">" and len(token) < 9:
                self.tail = token
            elif (new := _STATES.get(token.lower())) is not None:
                out += self._take()
                self.kind = new
            else:
                self.held += token
        return out + (self._take() if self.kind == "message" else [])

    def drain(self) -> list[tuple[str, str]]:
        """All that waits, before another event and at the end; an open action stays open."""
        self.held, self.tail = self.held + self.tail, ""
        return self._take()

    def _take(self) -> list[tuple[str, str]]:
        out, self.held = ([(self.kind, self.held)] if self.held else []), ""
        return out


#: Rows of the streams: ``part`` is the place among the pieces of one event.
ROW = "session string, seq bigint, part bigint, kind string, content string"


def _numbered(rows: list[tuple], late: bool) -> pd.DataFrame:
    """Rows with their place within their event; what comes out after a silence comes behind all else of its event."""
    parts, last, n = [], None, 0
    for row in rows:
        n = n + 1 if row[1] == last else (1 << 20 if late else 0)
        last = row[1]
        parts.append((row[0], row[1], n, *row[2:]))
    return pd.DataFrame(parts, columns=["session", "seq", "part", "kind", "content"])


def split_stream(events: DataFrame, idle_ms: int | None = 3_600_000) -> DataFrame:
    """Stream of (session, seq, kind, content) to (session, seq, part, kind, content) with prose and actions apart.

    Events of a micro-batch are sorted by ``seq`` inside the operator. A session that is silent for ``idle_ms`` is drained and
    forgotten, so the state is bounded by the sessions alive. A run over what is there now takes None: it would never end
    while it waits for silence."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, held, tail, seq = state.get if state.exists else ("message", "", "", -1)
        splitter, rows = ActionSplitter(kind, held, tail), []
        if state.hasTimedOut:
            rows += [(key[0], seq, *piece) for piece in splitter.drain()]
            state.remove()
        else:
            batch = pd.concat(list(frames)).sort_values("seq", kind="stable")
            for seq, kind, content in zip(batch["seq"].tolist(), batch["kind"].tolist(), batch["content"].tolist(), strict=True):
                if kind == "text":
                    rows += [(key[0], seq, *piece) for piece in splitter.feed(content or "")]
                else:
                    rows += [(key[0], seq, *piece) for piece in splitter.drain()]
                    rows.append((key[0], seq, kind, content))
                    if kind in ("status", "error"):
                        splitter = ActionSplitter(splitter.kind)
            state.update((*splitter.state, int(seq)))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield _numbered(rows, state.hasTimedOut)

    return events.groupBy("session").applyInPandasWithState(
        step, ROW, "kind string, held string, tail string, seq bigint", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


class TurnMapper:
    """Raw events of a session to what its reader sees. ``fragments``: whether text came in fragments; ``tools``: the tool ids seen, a set or anything
    with ``in`` and ``add``."""

    def __init__(self, fragments: bool = False, tools=None):
        self.fragments, self.tools = fragments, set() if tools is None else tools

    def feed(self, kind: str, tool_id: str | None, content: str | None, failed: bool, subtype: str | None = None) -> list[tuple[str, str]]:
        content = content or ""
        if kind == "text_delta":
            self.fragments = self.fragments or bool(content)
            return [("text", content)] if content else []
        if kind == "thinking_delta":
            return [("reasoning", content)] if content else []
        if kind == "text_full":  # only where no fragment came before it
            return [("text", content.strip())] if content.strip() and not self.fragments else []
        if kind == "tool":
            if tool_id in self.tools:
                return []
            self.tools.add(tool_id)
            return [("tool", content[:MOST_STEP])]
        if kind == "result":
            reason = content.strip()
            return [("error", NO_REASON if reason in ("", subtype) else reason[:MOST_REASON])] if failed else [("status", COMPLETE)]
        return []


#: Columns of raw events behind ``session``.
RAW = ("seq", "kind", "tool_id", "content", "failed", "subtype")


def _turn_rows(session: str, batch: pd.DataFrame, mapper: TurnMapper, splitter: ActionSplitter) -> tuple[list[tuple], ActionSplitter, int]:
    """What the events of a batch, by ``seq``, give; the splitter that holds what can't be decided yet; and the last ``seq``."""
    rows, seq = [], -1
    for seq, kind, tool_id, content, failed, subtype in zip(*(batch.sort_values("seq", kind="stable")[c].astype(object).where(lambda x: x.notna(), None).tolist() for c in RAW), strict=True):
        for what, said in mapper.feed(kind, tool_id, content, bool(failed), subtype):
            if what == "text":
                rows += [(session, seq, *piece) for piece in splitter.feed(said)]
                continue
            rows += [(session, seq, *piece) for piece in splitter.drain()]
            rows.append((session, seq, what, said))
            if what in ("status", "error"):
                splitter = ActionSplitter(splitter.kind)
    return rows, splitter, int(seq)


def turn_stream(events: DataFrame, idle_ms: int | None = 3_600_000) -> DataFrame:
    """Stream of raw events (session and RAW) to (session, seq, part, kind, content): mapped, and with
    prose and proposed actions apart, in one stateful operator, so that the order of a session holds through both steps.

    Any other event than text first drains what the splitter holds. The state of a session is a flag, its tool ids and what
    can't be decided yet; it is forgotten after ``idle_ms`` of silence."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fragments, tools, kind, held, tail, seq = state.get if state.exists else (False, [], "message", "", "", -1)
        mapper, splitter = TurnMapper(fragments, set(tools)), ActionSplitter(kind, held, tail)
        if state.hasTimedOut:
            rows = [(key[0], seq, *piece) for piece in splitter.drain()]
            state.remove()
        else:
            rows, splitter, seq = _turn_rows(key[0], pd.concat(list(frames)), mapper, splitter)
            state.update((mapper.fragments, list(mapper.tools), *splitter.state, seq))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield _numbered(rows, state.hasTimedOut)

    return events.groupBy("session").applyInPandasWithState(
        step, ROW, "fragments boolean, tools array<string>, kind string, held string, tail string, seq bigint", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


class _Seen:
    """Ids in a map state that forgets each one after its time to live."""

    def __init__(self, ids):
        self.ids = ids

    def __contains__(self, tool_id: str | None) -> bool:
        return self.ids.containsKey((tool_id or "",))

    def add(self, tool_id: str | None) -> None:
        self.ids.updateValue((tool_id or "",), (True,))


class TurnProcessor(StatefulProcessor):
    """The steps of ``turn_stream`` with state of its own kinds: what can't be decided yet is a value, the tool ids are a map from which each leaves
    ``tool_ttl_ms`` after it was seen, and a timer drains and forgets a session after ``idle_ms`` of silence. An event of a session costs the same
    however many tools it has used."""

    def __init__(self, tool_ttl_ms: int, idle_ms: int):
        self.tool_ttl_ms, self.idle_ms = tool_ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "fragments boolean, kind string, held string, tail string, seq bigint")
        self.tools = handle.getMapState("tools", "tool_id string", "seen boolean", self.tool_ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fragments, *held, _ = self.turn.get() if self.turn.exists() else (False, "message", "", "", -1)
        mapper = TurnMapper(fragments, _Seen(self.tools))
        found, splitter, seq = _turn_rows(key[0], pd.concat(list(rows)), mapper, ActionSplitter(*held))
        self.turn.update((mapper.fragments, *splitter.state, seq))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _numbered(found, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.turn.exists():
            _, *held, seq = self.turn.get()
            yield _numbered([(key[0], seq, *piece) for piece in ActionSplitter(*held).drain()], True)
        self.turn.clear()
        self.tools.clear()

    def close(self) -> None:
        pass


def turn_stream_expiring(events: DataFrame, tool_ttl_ms: int = 86_400_000, idle_ms: int = 3_600_000) -> DataFrame:
    """``turn_stream`` with expiring state (``TurnProcessor``). It needs the RocksDB state store (``STATE_STORE``) and, since time alone changes its
    state, a trigger that goes on: a run over what is there now never ends."""
    return events.groupBy("session").transformWithStateInPandas(TurnProcessor(tool_ttl_ms, idle_ms), ROW, "Append", "ProcessingTime")


#: The setting that expiring state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def once_per_tool(events: DataFrame, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each (session, tool id) once; ids are forgotten after ``delay`` of event time."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(["session", "tool_id"])
