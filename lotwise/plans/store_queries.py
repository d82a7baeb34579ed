"""Keyed tables, event folds, transcripts and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds
from ..operators import records as C
from ..operators import stores as S
from ..operators import transcripts as T
from ..sources.tables import stream_table, table
from ..sources.sinks import append_batch, read_ledger, scratch, turn_sink, write_results
from ..streaming.acts import once_per_tool, split_stream, turn_stream
from ..streaming.windows import run_available
from . import hosts as H
from .registry import query

#: Saved searches: the latest signup of a user; and edits of them: the latest view.
SAVED = H.ACTION + """,
 old AS (SELECT user_id, k AS name, at_s AS created_at FROM action WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_s DESC, event_id DESC) = 1),
 edit AS (SELECT user_id + 20 AS user_id, 'edit ' || k AS name, at_s AS created_at FROM action WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_s DESC, event_id DESC) = 1)"""


def saved(spark, sf_dir):
    a = H.actions(spark, sf_dir)
    last = lambda kind: S.first_appearance(a.filter(F.col("event_type") == kind), ["user_id"], [F.desc("at_s"), F.desc("event_id")])
    old = last("signup").select("user_id", F.col("k").alias("name"), F.col("at_s").alias("created_at"))
    edits = last("view").select((F.col("user_id") + 20).alias("user_id"), F.concat(F.lit("edit "), F.col("k")).alias("name"), F.col("at_s").alias("created_at"))
    return old, edits


@query("keyed_upsert", f"WITH {SAVED} SELECT * FROM edit UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM edit)")
def keyed_upsert(spark, sf_dir):
    return S.upsert(*saved(spark, sf_dir), "user_id")


@query("capped_upsert", f"""WITH {SAVED}, room AS (SELECT greatest(155 - count(*), 0) AS room FROM old),
 fits AS (SELECT * FROM edit WHERE user_id NOT IN (SELECT user_id FROM old) QUALIFY row_number() OVER (ORDER BY user_id) <= (SELECT room FROM room)),
 new AS (SELECT * FROM edit WHERE user_id IN (SELECT user_id FROM old) UNION ALL SELECT * FROM fits)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)""")
def capped_upsert(spark, sf_dir):
    return S.capped_upsert(*saved(spark, sf_dir), "user_id", 155, refuse=False)


@query("capped_upsert_refused", f"""WITH {SAVED}, unknown AS (SELECT *, row_number() OVER (ORDER BY user_id) AS nth FROM edit WHERE user_id NOT IN (SELECT user_id FROM old))
SELECT user_id, name, created_at FROM unknown WHERE nth > greatest(20 - (SELECT count(*) FROM old), 0)""")
def capped_upsert_refused(spark, sf_dir):
    """New keys that a full store refuses."""
    return S.refused(*saved(spark, sf_dir), "user_id", 20)


@query("replace_in_place", f"WITH {SAVED} SELECT o.user_id, CASE WHEN e.user_id IS NULL THEN o.name ELSE e.name END AS name, o.created_at FROM old o LEFT JOIN edit e ON o.user_id = e.user_id")
def replace_in_place(spark, sf_dir):
    """Fields of known rows are replaced; the time of creation stays, unknown ids are ignored."""
    old, edits = saved(spark, sf_dir)
    return S.replace_fields(old, edits, "user_id", ["name"])


@query("stamped_by_jobs", f"""WITH {SAVED}, done AS (SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_orderstatus = 'F')
SELECT o.user_id, o.name, CASE WHEN d.user_id IS NULL THEN o.created_at ELSE {H.EVENTS_NOW} END AS last_run_at FROM old o LEFT JOIN done d ON o.user_id = d.user_id""")
def stamped_by_jobs(spark, sf_dir):
    """Saved searches whose job has succeeded get the time of that run; failed jobs leave the stamp."""
    old, _ = saved(spark, sf_dir)
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("saved_search_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"))
    return S.stamped_by_jobs(old.withColumnRenamed("created_at", "last_run_at"), jobs, "user_id", "last_run_at", H.EVENTS_NOW)


@query("newest_first_defaults", f"WITH {SAVED} SELECT user_id, name, created_at, CASE WHEN user_id % 3 = 0 THEN 'x' ELSE '' END AS hidden, CAST(row_number() OVER (ORDER BY coalesce(created_at, 0) DESC, user_id) AS INTEGER) AS place FROM old")
def newest_first_defaults(spark, sf_dir):
    """A list newest first, with missing lists read as empty ones."""
    old, _ = saved(spark, sf_dir)
    rows = old.withColumn("hidden", F.when(F.col("user_id") % 3 == 0, F.array(F.lit("x"))))
    out = S.newest_first(rows, "user_id", lists=["hidden"]).withColumn("hidden", F.array_join("hidden", ","))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("created_at", F.lit(0)).desc(), "user_id")))


@query("photos_with_ttl", f"WITH {H.CACHE} SELECT CAST(p_partkey AS VARCHAR) AS property_id, CASE WHEN coalesce({H.CACHE_NOW} - updated_at < {H.CACHE_TTL}, false) THEN 'a,b' ELSE '' END AS photos FROM part LEFT JOIN cache ON property_id = CAST(p_partkey AS VARCHAR)")
def photos_with_ttl(spark, sf_dir):
    """Stored photos of each key, none where they are missing or stale."""
    stored = H.cache(spark, sf_dir).select("property_id", F.array(F.lit("a"), F.lit("b")).alias("photos"), F.col("updated_at").alias("captured_at"))
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("property_id"))
    return S.stored_photos(wanted, stored, "property_id", H.CACHE_NOW, H.CACHE_TTL).select("property_id", F.array_join("photos", ",").alias("photos"))


@query("swept_results", f"WITH {H.ACTION}, j AS (SELECT event_id // 7 AS job_id, min(at_s) AS created_at FROM action GROUP BY 1) SELECT event_id // 7 AS job_id, event_id FROM action WHERE event_id // 7 IN (SELECT job_id FROM j WHERE {H.EVENTS_NOW} - created_at < 864000)")
def swept_results(spark, sf_dir):
    """Results of jobs that were swept go with them."""
    rows = H.actions(spark, sf_dir).withColumn("job_id", F.floor(F.col("event_id") / 7))
    jobs = rows.groupBy("job_id").agg(F.min("at_s").alias("created_at"))
    return S.swept_results(rows.select("job_id", "event_id"), jobs, "job_id", H.EVENTS_NOW, 864_000)


@query("progress_fold", f"WITH {H.ACTION} SELECT event_id // 7 AS job_id, event_type AS phase, max(CAST(k AS BIGINT)) AS done, max(event_id % 50) AS total FROM action GROUP BY 1, 2")
def progress_fold(spark, sf_dir):
    """Counters of each phase of a job, which never go back."""
    rows = H.actions(spark, sf_dir).select(F.floor(F.col("event_id") / 7).alias("job_id"), F.col("event_type").alias("phase"), F.col("k").cast("bigint").alias("done"), (F.col("event_id") % 50).alias("total"))
    return S.fold_progress(rows, "job_id", "phase", "done", "total")


@query("known_modes", "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'browser' ELSE 'api' END AS mode, event_id % 3 = 2 AS rejected FROM events")
def known_modes(spark, sf_dir):
    """A stored setting, the default where it isn't known, and which ones a save would reject."""
    mode = F.element_at(F.array(F.lit("api"), F.lit("browser"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", C.known_mode(mode).alias("mode"), C.bad_mode(mode).alias("rejected"))


@query("delete_idempotent", f"WITH {SAVED} SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM edit WHERE user_id % 3 = 0)")
def delete_idempotent(spark, sf_dir):
    old, edits = saved(spark, sf_dir)
    return S.delete(old, edits.filter("user_id % 3 = 0"), "user_id")


@query("upsert_tombstone", f"""WITH {H.CACHE}, rec AS (SELECT CAST(p_partkey AS VARCHAR) AS property_id, CAST(3 AS INTEGER) AS schema_version FROM part WHERE p_partkey % 7 = 0),
 bad AS (SELECT CAST(p_partkey AS VARCHAR) AS property_id FROM part WHERE p_partkey % 14 = 0 OR p_partkey % 15 = 1),
 new AS (SELECT property_id, schema_version, CAST({H.NOW} AS BIGINT) AS updated_at, CAST(NULL AS BIGINT) AS failed_at FROM rec WHERE property_id NOT IN (SELECT property_id FROM bad)
  UNION ALL SELECT property_id, NULL, NULL, CAST({H.NOW} AS BIGINT) FROM bad)
SELECT * FROM new UNION ALL SELECT property_id, schema_version, updated_at, failed_at FROM cache WHERE property_id NOT IN (SELECT property_id FROM new)""")
def upsert_tombstone(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string").alias("property_id")
    records = part.filter("p_partkey % 7 = 0").select(key, F.lit(3).alias("schema_version"))
    failed = part.filter("p_partkey % 14 = 0 or p_partkey % 15 = 1").select(key)
    return S.upsert_with_tombstones(H.cache(spark, sf_dir), records, failed, "property_id", H.NOW)


STATE = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'scraping' WHEN 'signup' THEN 'enriching' WHEN 'purchase' THEN CASE WHEN value > 60 THEN 'succeeded' ELSE 'enriching' END ELSE CASE WHEN value > 80 THEN 'failed' ELSE 'scraping' END END"


def states(spark, sf_dir):
    v = F.col("value")
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "scraping").when(F.col("event_type") == "signup", "enriching").when(F.col("event_type") == "purchase", F.when(v > 60, "succeeded").otherwise("enriching")).otherwise(F.when(v > 80, "failed").otherwise("scraping"))
    return H.actions(spark, sf_dir).withColumn("status", status).withColumn("job_id", F.floor(F.col("event_id") / 7))


@query("job_state_fold", f"""WITH {H.ACTION}, e AS (SELECT event_id // 7 AS job_id, event_id, {STATE} AS status FROM action)
SELECT job_id, coalesce(arg_min(status, event_id) FILTER (status IN ('succeeded', 'failed', 'cancelled')), arg_max(status, event_id)) AS status, bool_or(status IN ('succeeded', 'failed', 'cancelled')) AS ended, count(*) AS events FROM e GROUP BY job_id""")
def job_state_fold(spark, sf_dir):
    return S.fold_states(states(spark, sf_dir), "job_id", ["event_id"], ("succeeded", "failed", "cancelled"))


@query("job_patch_fold", f"""WITH {H.ACTION}, e AS (SELECT event_id // 7 AS job_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE k END AS note, event_type IN ('error', 'view') AS sets FROM action)
SELECT job_id, (arg_max(struct_pack(v := note), event_id) FILTER (sets)).v AS note FROM e GROUP BY job_id""")
def job_patch_fold(spark, sf_dir):
    e = H.actions(spark, sf_dir).withColumn("job_id", F.floor(F.col("event_id") / 7))
    e = e.withColumn("note", F.when(F.col("event_type") != "error", F.col("k"))).withColumn("set_fields", F.when(F.col("event_type").isin("error", "view"), F.array(F.lit("note"))).otherwise(F.array().cast("array<string>")))
    return S.fold_patches(e, "job_id", ["event_id"], ["note"])


@query("ttl_sweep", f"WITH {H.ACTION}, j AS (SELECT event_id // 7 AS job_id, min(at_s) AS created_at FROM action GROUP BY 1) SELECT job_id, created_at FROM j WHERE {H.EVENTS_NOW} - created_at < 864000")
def ttl_sweep(spark, sf_dir):
    jobs = H.actions(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 7).alias("job_id")).agg(F.min("at_s").alias("created_at"))
    return S.swept(jobs, H.EVENTS_NOW, 864_000)


@query("dedup_first_appearance", f"WITH {H.HIDDEN} SELECT scope, id, at_s, event_id FROM entity WHERE event_type IN ('error', 'click') QUALIFY row_number() OVER (PARTITION BY scope, id ORDER BY event_id) = 1")
def dedup_first_appearance(spark, sf_dir):
    a = H.actions(spark, sf_dir).filter("event_type in ('error', 'click')")
    unit = (F.col("k").cast("bigint") * 10 + 1 + F.col("event_id") % 7).cast("string")
    rows = a.select("scope", F.when(F.col("scope") == "property", F.col("k")).otherwise(unit).alias("id"), "at_s", "event_id")
    return S.first_appearance(rows, ["scope", "id"], ["event_id"])


@query("transcript_tail4", "SELECT conv_id, turn, role, text FROM conversations WHERE regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def transcript_tail4(spark, sf_dir):
    return T.last_turns(table(spark, sf_dir, "conversations"), 4, "conv_id", "turn", "text").select("conv_id", "turn", "role", "text")


@query("transcript_tail24", "SELECT conv_id, turn, role, text FROM conversations WHERE regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 24")
def transcript_tail24(spark, sf_dir):
    return T.last_turns(table(spark, sf_dir, "conversations"), 24, "conv_id", "turn", "text").select("conv_id", "turn", "role", "text")


KIND = "CASE event_type WHEN 'view' THEN 'reasoning' WHEN 'click' THEN 'message' WHEN 'signup' THEN 'status' WHEN 'purchase' THEN 'tool' ELSE event_type END"


ISLANDS = f"""WITH {H.ACTION}, e AS (SELECT user_id, event_id, k, {KIND} AS kind FROM action),
 step AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, CASE WHEN kind = 'reasoning' THEN row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) END AS of_kind FROM e WHERE kind NOT IN ('message', 'status')),
 island AS (SELECT *, CASE WHEN kind = 'reasoning' THEN 'r' || (nth - of_kind) ELSE 's' || nth END AS g FROM step),
 merged AS (SELECT user_id, g, min(kind) AS kind, count(*) AS n, min(event_id) AS first, string_agg(k, '' ORDER BY event_id) AS content FROM island GROUP BY user_id, g)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS step, kind, n, first, content FROM merged"""


def _islands(spark, sf_dir, spread):
    a = H.actions(spark, sf_dir).select("user_id", "event_id", "event_type", "k")
    kind = F.when(F.col("event_type") == "view", "reasoning").when(F.col("event_type") == "click", "message").when(F.col("event_type") == "signup", "status").when(F.col("event_type") == "purchase", "tool").otherwise(F.col("event_type"))
    return T.merged_runs(a, kind, "user_id", "event_id", "k", spread=spread)


@query("reasoning_islands", ISLANDS)
def reasoning_islands(spark, sf_dir):
    """Fragments of reasoning with no tool or error between them are one step; prose and status don't break them."""
    return _islands(spark, sf_dir, False)


@query("reasoning_islands_spread", ISLANDS)
def reasoning_islands_spread(spark, sf_dir):
    """The same with a session of any length spread over many tasks."""
    return _islands(spark, sf_dir, True)


@query("recorded_turns", """WITH e AS (SELECT user_id, event_id // 40 AS turn, event_id, CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'message' WHEN 'signup' THEN 'status' WHEN 'purchase' THEN 'tool' ELSE 'error' END AS kind, regexp_extract(props, '"k":\\s*(\\d+)', 1) AS k, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS ms FROM events),
 q AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, turn ORDER BY event_id) AS before FROM e WHERE kind <> 'status'),
 p AS (SELECT user_id, turn, trim(string_agg(CASE WHEN coalesce(before <> 'message', false) THEN chr(10) || chr(10) ELSE '' END || k, '' ORDER BY event_id), chr(10) || ' ') AS content FROM q WHERE kind = 'message' GROUP BY user_id, turn)
SELECT e.user_id, e.turn, count(*) FILTER (kind = 'tool') AS tool_count, max(ms) - min(ms) AS think_ms, coalesce(any_value(p.content), '') AS content FROM e LEFT JOIN p ON p.user_id = e.user_id AND p.turn = e.turn GROUP BY e.user_id, e.turn""")
def recorded_turns(spark, sf_dir):
    """Turns as their reader saw them: prose with blank lines after other events, tools counted, time from first to last event."""
    kind = F.when(F.col("event_type").isin("view", "click"), "message").when(F.col("event_type") == "signup", "status").when(F.col("event_type") == "purchase", "tool").otherwise("error")
    rows = H.actions(spark, sf_dir).select("user_id", F.floor(F.col("event_id") / 40).alias("turn"), "event_id", kind.alias("kind"), "k", (F.col("at_s") * 1000).alias("at"))
    return T.recorded_turns(rows, ("user_id", "turn"), "event_id", "kind", "k")


PROSE = H.ACTION + """, e AS (SELECT user_id, event_id, k, CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'message' WHEN 'signup' THEN 'status' ELSE event_type END AS kind FROM action),
 q AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e WHERE kind <> 'status'),
 piece AS (SELECT user_id, event_id, CASE WHEN coalesce(before <> 'message', false) THEN chr(10) || chr(10) ELSE '' END || k AS piece FROM q WHERE kind = 'message')"""


def prose(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "message").when(F.col("event_type") == "signup", "status").otherwise(F.col("event_type"))
    return T.separated(H.actions(spark, sf_dir).withColumn("kind", kind), "user_id", "event_id", "kind", "k").select("user_id", "event_id", "piece")


@query("prose_separator", f"WITH {PROSE} SELECT * FROM piece")
def prose_separator(spark, sf_dir):
    return prose(spark, sf_dir)


@query("running_prose", f"WITH {PROSE} SELECT user_id, event_id, string_agg(piece, '') OVER (PARTITION BY user_id ORDER BY event_id) AS so_far FROM piece")
def running_prose(spark, sf_dir):
    return T.running_text(prose(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "so_far")


@query("running_prose_length", f"WITH {PROSE} SELECT user_id, event_id, CAST(sum(length(piece)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS length_so_far FROM piece")
def running_prose_length(spark, sf_dir):
    return T.so_far_length(prose(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "length_so_far")


RAW_CONTENT = """CASE kind WHEN 'text_delta' THEN CASE WHEN event_id % 5 = 0 THEN '' ELSE k END WHEN 'text_full' THEN CASE WHEN event_id % 5 = 1 THEN '  ' ELSE ' ' || k || ' ' END WHEN 'thinking_delta' THEN CASE WHEN event_id % 5 <> 0 THEN k END
   WHEN 'tool' THEN CASE WHEN event_id % 5 = 2 THEN repeat(k || '-', 150) ELSE k END ELSE CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' over ' ELSE k END END"""
MAPPED = f"""WITH e AS (SELECT user_id, event_id, value, CASE event_type WHEN 'view' THEN 'text_delta' WHEN 'click' THEN 'text_full' WHEN 'signup' THEN 'thinking_delta' WHEN 'purchase' THEN 'tool' ELSE 'result' END AS kind, regexp_extract(props, '"k":\\s*(\\d+)', 1) AS k FROM events),
 c AS (SELECT *, {RAW_CONTENT} AS content FROM e),
 m AS (SELECT *, coalesce(max(CASE WHEN kind = 'text_delta' AND content <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, row_number() OVER (PARTITION BY user_id, kind, k ORDER BY event_id) AS nth FROM c),
 mapped AS (SELECT user_id, event_id, k AS tool_id, CASE kind WHEN 'text_delta' THEN 'text' WHEN 'text_full' THEN 'text' WHEN 'thinking_delta' THEN 'reasoning' WHEN 'tool' THEN 'tool' ELSE CASE WHEN value > 50 THEN 'error' ELSE 'status' END END AS kind,
   CASE kind WHEN 'text_full' THEN trim(content) WHEN 'tool' THEN substr(content, 1, 300) WHEN 'result' THEN CASE WHEN value > 50 THEN CASE WHEN trim(content) IN ('', 'over') THEN '{T.NO_REASON}' ELSE trim(content) END ELSE 'complete' END ELSE content END AS content
   FROM m WHERE CASE kind WHEN 'text_delta' THEN content <> '' WHEN 'text_full' THEN seen = 0 AND trim(content) <> '' WHEN 'thinking_delta' THEN coalesce(content, '') <> '' WHEN 'tool' THEN nth = 1 ELSE true END)"""


def raw_turns(events):
    """Events as the raw ones of a conversation: some fragments are empty, some texts blank, some steps long, some reasons none."""
    kind = F.when(F.col("event_type") == "view", "text_delta").when(F.col("event_type") == "click", "text_full").when(F.col("event_type") == "signup", "thinking_delta").when(F.col("event_type") == "purchase", "tool").otherwise("result")
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1)
    rows = events.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), "event_id", kind.alias("kind"), k.alias("k"), (F.col("value") > 50).alias("failed"))
    return rows.select("session", "seq", "kind", F.col("k").alias("tool_id"), F.expr(RAW_CONTENT).alias("content"), "failed", F.lit("over").alias("subtype"))


@query("event_mapping", MAPPED + " SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, kind, tool_id, content FROM mapped")
def event_mapping(spark, sf_dir):
    return T.mapped_events(raw_turns(table(spark, sf_dir, "events"))).select("session", "seq", "kind", "tool_id", "content")


def act_events(rows):
    """Whole turns as text events, with a proposed action in each assistant turn that is cut in the middle of its tags. Angle
    brackets of the texts become braces, so that only the planted tags count."""
    text = F.translate(F.coalesce("text", F.lit("")), "<>", "{}")
    half = F.floor(F.length(text) / 2).cast("int")
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    turn = F.col("turn").cast("string")
    chunks = F.array(F.concat(head, F.lit("<a")), F.concat(F.lit("ct>go "), turn, F.lit("</ac")), F.concat(F.lit("t>"), tail, F.lit("<ACT>"), turn, F.lit("</act> a < b <i>")))
    out = rows.select("conv_id", "turn", "role", F.posexplode(F.when(F.col("role") == "assistant", chunks).otherwise(F.array(text))).alias("at", "content"))
    return out.select(F.col("conv_id").cast("string").alias("session"), (F.col("turn") * 10 + F.col("at")).alias("seq"), F.when(F.col("role") == "assistant", "text").otherwise("tool").alias("kind"), "content")


SPLIT = """a AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn, translate(coalesce(text, ''), '<>', '{}') AS text FROM conversations WHERE role = 'assistant'),
 piece AS (SELECT session, turn, 1 AS nth, 'message' AS kind, substr(text, 1, length(text) // 2) AS content FROM a UNION ALL SELECT session, turn, 2, 'action', 'go ' || turn FROM a
  UNION ALL SELECT session, turn, 3, 'message', substr(text, length(text) // 2 + 1) FROM a UNION ALL SELECT session, turn, 4, 'action', CAST(turn AS VARCHAR) FROM a UNION ALL SELECT session, turn, 5, 'message', ' a < b <i>' FROM a)"""


@query("act_split_batch", f"WITH {SPLIT} SELECT session, kind, string_agg(content, '' ORDER BY turn, nth) AS content FROM piece GROUP BY session, kind")
def act_split_batch(spark, sf_dir):
    """All prose and all actions of each session, in order."""
    split = T.split_actions(act_events(table(spark, sf_dir, "conversations")))
    return split.groupBy("session", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "piece", "content"))), lambda x: x["content"]), "").alias("content"))


@query("event_stream_availablenow", f"""WITH {SPLIT} SELECT session, kind, string_agg(content, '' ORDER BY turn, nth) AS content FROM piece GROUP BY session, kind
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'tool', string_agg(translate(coalesce(text, ''), '<>', '{{}}'), '' ORDER BY turn) FROM conversations WHERE role <> 'assistant' GROUP BY conv_id""")
def event_stream_availablenow(spark, sf_dir):
    """The same splitting as a stream over all turns: contents by session and kind equal those of the batch."""
    turns = stream_table(spark, sf_dir, "conversations")
    rows = run_available(split_stream(act_events(turns), idle_ms=None), spark, scratch(spark))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "content"))), lambda x: x["content"]), "")
    return rows.groupBy("session", "kind").agg(joined.alias("content"))


@query("turn_stream_availablenow", MAPPED + " SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, CASE kind WHEN 'text' THEN 'message' ELSE kind END AS kind, content FROM mapped")
def turn_stream_availablenow(spark, sf_dir):
    """Mapping and splitting as one stateful stream over raw events, by the rules of the batch form."""
    return run_available(turn_stream(raw_turns(stream_table(spark, sf_dir, "events")), idle_ms=None), spark, scratch(spark)).drop("part")


@query("tools_once_stream", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS session, regexp_extract(props, '"k":\\s*(\\d+)', 1) AS tool_id FROM events""")
def tools_once_stream(spark, sf_dir):
    """Each tool id of a session once, as a stream that forgets ids after the watermark."""
    raw = stream_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.regexp_extract("props", r'"k":\s*(\d+)', 1).alias("tool_id"), F.col("ts").cast("timestamp").alias("ts"))
    return run_available(once_per_tool(raw, delay="400 days"), spark, scratch(spark)).select("session", "tool_id")


@query("turns_appended_once", "SELECT conv_id AS session, turn, role, text FROM conversations")
def turns_appended_once(spark, sf_dir):
    """Turns appended by a stream whose batches all run twice, after an attempt that was cut off, and beside turns that were there before: none is
    there twice."""
    path = scratch(spark) + "/turns"
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")
    append_batch(rows.filter("session % 2 = 0"), path, -1, ("session", "turn"), ("role", "text"))
    rows.filter("turn = 1").withColumn("text", F.lit("half")).write.parquet(f"{path}/batch=0")  # no marker: never committed
    sink = turn_sink(path)

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    stream = stream_table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read_ledger(spark, path, rows.schema, ("session", "turn"), ("role", "text")).drop("batch")


@query("results_by_job", "SELECT o_orderkey, o_custkey, o_orderkey % 4 AS job_id FROM orders WHERE o_orderkey % 4 <> 1 UNION ALL SELECT o_orderkey, -1, 1 FROM orders WHERE o_orderkey % 4 = 1")
def results_by_job(spark, sf_dir):
    """Results in a folder a job: writing one job again replaces its own only."""
    path = scratch(spark) + "/results"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4).alias("job_id"))
    write_results(rows, path)
    write_results(rows.filter("job_id = 1").withColumn("o_custkey", F.lit(-1).cast("bigint")), path)
    return spark.read.parquet(path).withColumn("job_id", F.col("job_id").cast("bigint"))


@query("event_windows", "SELECT CAST(floor(epoch(time_bucket(INTERVAL 1 HOUR, ts))) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Event-time counts by hour, in batch; ``streaming.windows`` has the same over a stream."""
    path = f"{sf_dir}/events.parquet"
    events = spark.read.parquet(path)
    return events.groupBy((F.floor(epoch_seconds(F.col("ts")) / 3600) * 3600).alias("start"), "event_type").agg(F.count("*").alias("n"))
