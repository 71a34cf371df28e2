"""Streaming queries over ``events`` and ``embeddings``, each run on all available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import series as SE
from gridloom.plans.models import CENTRES, PropsScorer, centre_scorer
from gridloom.plans.registry import query, r6
from gridloom.session import scratch_path
from gridloom.streaming import keyed as KS
from gridloom.streaming import operators as S
from gridloom.streaming import runs as R


def event_stream(t):
    return R.table_stream(t.spark, t.folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def plain(col):
    return F.col(col).cast("timestamp_ntz").alias(col)


@query("stream_scores", "R01 M01", f"WITH {CENTRES} SELECT vec_id, k::BIGINT AS class, round(p, 6) AS probability FROM pr WHERE place = 1")
def stream_scores(t):
    scored = S.score_stream(R.table_stream(t.spark, t.folder, "embeddings"), centre_scorer(t), ["vec_id"])
    return R.run_to_table(scored, "scores").withColumn("probability", r6("probability"))


@query("stream_failures", "R02", """
SELECT event_id, CASE WHEN k % 10 = 0 THEN 'failed' ELSE 'good' END AS folder FROM (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)""")
def stream_failures(t):
    scored = S.score_stream(event_stream(t).select("event_id", "props"), PropsScorer(), ["event_id"], guard=True)
    good, failed = S.split_failures(scored, "failures")
    return good.select("event_id", F.lit("good").alias("folder")).unionByName(failed.select("event_id", F.lit("failed").alias("folder")))


MARK = """m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS mark FROM events)"""


@query("stream_window_metrics", "R04 A12", f"""
WITH {MARK} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS largest FROM events, m
GROUP BY 1, 2, mark HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= mark""")
def stream_window_metrics(t):
    out = R.run_to_table(S.window_metrics(event_stream(t), "ts", "event_type", "value", "1 hour"), "windows")
    return out.select(plain("start"), "event_type", "n", r6("mean").alias("mean"), "largest")


@query("stream_sliding_metrics", "R04", f"""
WITH {MARK}, x AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k::INT) AS start, value, event_type FROM events, (SELECT unnest(range(6)) AS k))
SELECT start, event_type, count(*) AS n, max(value) AS largest FROM x, m GROUP BY 1, 2, mark HAVING start + INTERVAL 6 HOUR <= mark""")
def stream_sliding_metrics(t):
    out = R.run_to_table(S.window_metrics(event_stream(t), "ts", "event_type", "value", "6 hours", "1 hour"), "sliding")
    return out.select(plain("start"), "event_type", "n", "largest")


SESSIONS = """g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 14400000000 THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS session FROM g)"""


@query("user_sessions", "R03", f"""
WITH {SESSIONS} SELECT user_id, session::BIGINT AS session, min(ts) AS start, max(ts) AS last, count(*) AS rows FROM s GROUP BY 1, 2""")
def user_sessions(t):
    out = SE.sessions(t.events, "user_id", "ts", 4 * 3600)
    return out.select("user_id", "session", plain("start"), plain("last"), "rows")


@query("stream_sessions", "R03", f"""
WITH {SESSIONS}, {MARK} SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS rows FROM s, m GROUP BY user_id, session, mark HAVING max(ts) + INTERVAL 4 HOUR <= mark""")
def stream_sessions(t):
    out = R.run_to_table(S.session_stream(event_stream(t), "user_id", "ts", "4 hours"), "sessions")
    return out.select("user_id", plain("start"), plain("last"), "rows")


@query("stream_recent_buffer", "R05 W08", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""")
def stream_recent_buffer(t):
    """The events arrive in eight files, one per micro-batch; the buffers are read from the state store."""
    path = scratch_path(t.spark, "arrivals")
    t.events.select("user_id", "event_id", "ts", "value").repartition(8, "event_id").write.parquet(path)
    out = KS.run_buffer(R.folder_stream(t.spark, path), scratch_path(t.spark, "buffer"), "user_id", "ts", "event_id", 5)
    return out.select("user_id", "event_id", "value")


@query("stream_forgotten_buffer", "R05", """
WITH last AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1), m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS mark FROM events),
k AS (SELECT user_id FROM last, m WHERE date_trunc('millisecond', newest) + INTERVAL 6 HOUR > mark)
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events JOIN k USING (user_id)) WHERE r <= 3""")
def stream_forgotten_buffer(t):
    """Users without an event for six hours of the stream's own time are forgotten."""
    events = event_stream(t).select("user_id", "event_id", "ts", "value")
    out = KS.run_buffer(events, scratch_path(t.spark, "forgetful"), "user_id", "ts", "event_id", 3, idle="6 hours")
    return out.select("user_id", "event_id", "value")


# Every seventh job gets no answer; others get one after 0 to 4 minutes, every eleventh a second one at that time; every thirteenth answer names another job.
ANSWER_SQL = """a AS (SELECT DISTINCT CASE WHEN event_id % 13 = 5 THEN -event_id - 1 ELSE event_id END AS job, ts + to_minutes((event_id % 5)::INT) AS at FROM events WHERE event_id % 7 <> 0)"""


@query("stream_job_answers", "R06", f"""
WITH {ANSWER_SQL} SELECT coalesce(e.event_id, a.job) AS job, e.ts AS requested, a.at AS answered_at,
    CASE WHEN a.at IS NULL THEN 'unanswered' WHEN e.ts IS NULL THEN 'unrequested' ELSE 'answered' END AS status
FROM events e FULL OUTER JOIN a ON a.job = e.event_id AND a.at BETWEEN e.ts AND e.ts + INTERVAL 3 MINUTE""")
def stream_job_answers(t):
    """Jobs and answers as two streams; a last beat of both, a day later, closes what is open."""
    jobs, answers = scratch_path(t.spark, "jobs"), scratch_path(t.spark, "answers")
    events = t.events.select(F.col("event_id").alias("job"), "ts")
    beat = events.agg(F.lit(None).cast("long").alias("job"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    events.union(beat).write.parquet(jobs)
    named = F.when(F.col("job") % 13 == 5, -F.col("job") - 1).otherwise(F.col("job"))
    late = F.col("ts") + F.make_dt_interval(mins=(F.col("job") % 5).cast("int"))
    times = F.when(F.col("job") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    given = events.where("job % 7 <> 0").select(named.alias("job"), late.alias("ts"), F.explode(times)).drop("col")
    given.union(beat).write.parquet(answers)
    out = KS.run_matches(R.folder_stream(t.spark, jobs, 1000), R.folder_stream(t.spark, answers, 1000), scratch_path(t.spark, "matches"), "job", "ts", "3 minutes")
    return out.where("job IS NOT NULL").select("job", plain("requested"), plain("answered_at"), "status")


@query("stream_answers_once", "R06", "SELECT event_id, user_id FROM events")
def stream_answers_once(t):
    doubled = event_stream(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return R.run_to_table(S.answer_once(doubled, "event_id", "ts").select("event_id", "user_id"), "answers")


@query("stream_metric_log", "K03 R04", """SELECT event_type AS name, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def stream_metric_log(t):
    """Append the metric log by micro-batch and read it back."""
    path = scratch_path(t.spark, "log")

    def handle(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    R.run_batches(event_stream(t).select(F.col("event_type").alias("name"), "value", "ts"), "log", handle)
    log = t.spark.read.parquet(path)
    return log.groupBy("name").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total"))
