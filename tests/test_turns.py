"""Raw events of conversations: batch and streams say the same, and state expires."""

import time

import pytest
from pyspark.sql import functions as F

from lotwise.operators import transcripts as T
from lotwise.plans.store_queries import raw_turns
from lotwise.streaming import acts as A
from lotwise.streaming.windows import run_available

RAW = "session string, seq bigint, kind string, tool_id string, content string, failed boolean, subtype string"


def event(seq, kind, content=None, tool=None, failed=None, subtype=None, session="s"):
    return (session, seq, kind, tool, content, failed, subtype)


EVENTS = [
    event(1, "text_delta", ""), event(2, "text_full", " whole\n"), event(3, "thinking_delta", None), event(4, "text_delta", " part "), event(5, "text_full", "late"), event(6, "tool", "t" * 400, "1"), event(7, "tool", "t", "1"), event(8, "tool", "none"), event(9, "tool", "none again"),
    event(10, "other", "x"), event(11, "result", " over ", failed=True, subtype="over"), event(12, "result", " why ", failed=True, subtype="over"), event(13, "result", None, failed=True), event(14, "result", "r" * 2000, failed=True), event(15, "result", "fine", failed=False), event(16, "result"), event(17, "text_full", " \t"),
]


def rows(df):
    return sorted(tuple(r) for r in df.select("session", "seq", "kind", "content").collect())


def test_batch_and_stream_follow_the_same_rules(spark, tmp_path):
    events = spark.createDataFrame(EVENTS + [(*e[:1], *e[1:]) for e in (event(1, "text_full", "only this", session="t"),)], RAW)
    got = rows(T.mapped_events(events))
    assert got == sorted(
        [("s", 2, "text", "whole"), ("s", 4, "text", " part "), ("s", 6, "tool", "t" * 300), ("s", 8, "tool", "none"), ("s", 11, "error", T.NO_REASON), ("s", 12, "error", "why"), ("s", 13, "error", T.NO_REASON), ("s", 14, "error", "r" * 1000), ("s", 15, "status", "complete"), ("s", 16, "status", "complete"), ("t", 1, "text", "only this")]
    )
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    assert rows(run_available(A.turn_stream(stream, idle_ms=None), spark, f"{tmp_path}/out").withColumn("kind", F.when(F.col("kind") == "message", "text").otherwise(F.col("kind")))) == got


def test_batch_and_stream_agree_on_all_events(spark, data, tmp_path):
    raw = raw_turns(spark.read.parquet(f"{data}/events.parquet"))
    raw.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    streamed = run_available(A.turn_stream(stream, idle_ms=None), spark, f"{tmp_path}/out")
    assert rows(streamed.withColumn("kind", F.when(F.col("kind") == "message", "text").otherwise(F.col("kind")))) == rows(T.mapped_events(raw))


@pytest.fixture
def rocks(spark):
    key, value = A.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield spark
    spark.conf.set(key, before)


def test_an_expired_id_passes_again_and_an_idle_session_is_drained(rocks, tmp_path):
    """A tool id counts as seen for its time to live only; a session that is silent gives what it held and is forgotten."""
    spark = rocks

    def put(name, events):
        spark.createDataFrame(events, RAW).coalesce(1).write.parquet(f"{tmp_path}/made/{name}")
        (tmp_path / "in").mkdir(exist_ok=True)
        (file,) = (tmp_path / "made" / name).glob("*.parquet")
        file.rename(tmp_path / "in" / f"{name}.parquet")

    put("a", [event(1, "tool", "x", "1"), event(2, "tool", "x", "1"), event(3, "text_delta", "see <ac"), event(1, "text_delta", "open <act>half", session="idle")])
    schema = spark.createDataFrame([], RAW).schema
    stream = A.turn_stream_expiring(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), tool_ttl_ms=4000, idle_ms=12_000)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start(f"{tmp_path}/out")

    def wait_for(n, seconds=60):
        until = time.time() + seconds
        while time.time() < until and q.isActive:
            found = rows(spark.read.schema(A.ROW).parquet(f"{tmp_path}/out")) if (tmp_path / "out").exists() else []
            if len(found) >= n:
                return found
            time.sleep(0.3)
        raise AssertionError(f"{q.exception()}: only {found}")

    try:
        first = wait_for(3)
        assert first == [("idle", 1, "message", "open "), ("s", 1, "tool", "x"), ("s", 3, "message", "see ")]
        time.sleep(5)
        put("b", [event(4, "tool", "x", "1"), event(5, "tool", "x", "1"), event(6, "text_full", "not after fragments")])
        second = wait_for(5)
        assert ("s", 4, "tool", "x") in second and ("s", 5, "tool", "x") not in second and ("s", 4, "message", "<ac") in second
        last = wait_for(6)
        assert ("idle", 1, "action", "half") in last and len(last) == 6
    finally:
        q.stop()


def one_session(spark, data):
    """All turns of all conversations as one session: text in small pieces with tags cut anywhere, and other events between them."""
    events, seq = [], 0
    for r in spark.read.parquet(f"{data}/conversations.parquet").orderBy("conv_id", "turn").collect():
        text = f"{r.text or ''} a < b <b>x</b> <ACT>do {r.turn}</act> and <act" + ("> open" if r.turn % 5 == 0 else "ed </ac")
        for at in range(0, len(text), 7 + r.turn):
            events.append(("all", seq, "text", text[at : at + 7 + r.turn]))
            seq += 1
        events.append(("all", seq, ("reasoning", "tool", "status", "reasoning", "error")[seq % 5], f"e{seq}"))
        seq += 1
    return spark.createDataFrame(events, "session string, seq bigint, kind string, content string"), events


def test_one_long_session_over_many_tasks_equals_the_state_machine(spark, data):
    rows, events = one_session(spark, data)
    splitter, want, run = A.ActionSplitter(), {}, 0
    for _, _, kind, content in events:
        pieces = splitter.feed(content) if kind == "text" else splitter.drain()
        for what, said in pieces:
            want.setdefault((run, what), []).append(said)
        if kind != "text":
            run += 1
    for what, said in splitter.drain():
        want.setdefault((run, what), []).append(said)
    got: dict = {}
    for r in T.split_actions(rows, spread=True).orderBy("run", "piece").collect():
        got.setdefault((r.run, r.kind), []).append(r.content)
    assert {k: "".join(v) for k, v in got.items()} == {k: "".join(v) for k, v in want.items()} and len(got) > 100


def test_spread_steps_and_separators_are_those_of_a_window(spark, data):
    rows, _ = one_session(spark, data)
    steps = [T.merged_runs(rows, F.col("kind"), spread=x).select("step", "kind", "n", "first", "content") for x in (True, False)]
    assert sorted(map(tuple, steps[0].collect())) == sorted(map(tuple, steps[1].collect()))
    prose = rows.withColumn("kind", F.when(F.col("kind") == "text", "message").otherwise(F.col("kind")))
    pieces = [T.separated(prose, spread=x).select("seq", "piece") for x in (True, False)]
    assert sorted(map(tuple, pieces[0].collect())) == sorted(map(tuple, pieces[1].collect()))
