"""Job-record operators over ``events``."""

from pyspark.sql import functions as F

from quire.operators import jobs as J
from quire.plans import fixtures as X
from quire.plans.fixtures import JOB_EVENTS
from quire.plans.registry import query, values_sql
from quire.streaming import jobs as SJ


@query(
    "j1_latest_job_state",
    f"""WITH {JOB_EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM job_events)
SELECT job_id, event_id, status, progress FROM k WHERE rn = 1""",
)
def j1(spark, sf):
    return J.latest_state(X.job_events(spark, sf))


# The SQL walks the records in order and keeps the state; Spark takes three minima.
FOLD = f"""{JOB_EVENTS},
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM job_events),
st AS (SELECT job_id, i, status AS given, CASE WHEN status IN ('done', 'failed') THEN status WHEN cancel AND status <> 'running' THEN 'cancelled' ELSE status END AS state,
    cancel AND status NOT IN ('done', 'failed') AS asked, status = 'running' AS started, CASE WHEN status IN ('done', 'failed') THEN event_id END AS result_event FROM o WHERE i = 1
  UNION ALL
  SELECT o.job_id, o.i, o.status, CASE WHEN s.state IN ('done', 'failed', 'cancelled') THEN s.state WHEN o.status IN ('done', 'failed') THEN CASE WHEN s.asked THEN 'cancelled' ELSE o.status END
     WHEN (s.asked OR o.cancel) AND NOT (s.started OR o.status = 'running') THEN 'cancelled' WHEN s.started OR o.status = 'running' THEN 'running' ELSE 'queued' END,
   s.asked OR (o.cancel AND s.state NOT IN ('done', 'failed', 'cancelled') AND o.status NOT IN ('done', 'failed')), s.started OR o.status = 'running',
   CASE WHEN s.state IN ('done', 'failed', 'cancelled') THEN s.result_event WHEN o.status IN ('done', 'failed') AND NOT s.asked THEN o.event_id END
  FROM st s JOIN o ON o.job_id = s.job_id AND o.i = s.i + 1),
fin AS (SELECT job_id, arg_max(state, i) AS status, arg_max(asked, i) AS cancel_requested, max(result_event) AS result_event FROM st GROUP BY job_id)"""


@query("j2_sticky_cancel", f"WITH RECURSIVE {FOLD} SELECT * FROM fin")
def j2(spark, sf):
    return J.fold_jobs(X.job_events(spark, sf))


@query(
    "j3_stage_defaults",
    f"""WITH {JOB_EVENTS}
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'custom' ELSE status END AS stage, greatest(0, least(100, trunc(progress - 50)))::BIGINT AS progress,
   20 + round_even(70.0::DOUBLE * (event_id % 8 + 1) / 8, 0)::BIGINT AS step_progress FROM job_events""",
)
def j3(spark, sf):
    e = X.job_events(spark, sf).withColumn("progress", F.col("progress") - 50)
    e = e.withColumn("stage", F.when(F.col("event_id") % 3 == 0, F.lit("custom")))
    done = F.col("event_id") % 8 + 1
    return J.stage_defaults(e).select("event_id", "stage", "progress", J.step_progress(done, F.lit(8)).alias("step_progress"))


@query(
    "j4_append_log",
    f"""WITH {JOB_EVENTS} SELECT job_id, event_id, event_type || ' ' || event_id AS message, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS line_no FROM job_events""",
)
def j4(spark, sf):
    e = X.job_events(spark, sf).select(
        "job_id", "ts", "event_id", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("message")
    )
    return J.job_log(e).select("job_id", "event_id", "message", "line_no")


@query(
    "j4_recent_log",
    f"""WITH {JOB_EVENTS}, l AS (SELECT * FROM job_events ORDER BY ts DESC, event_id DESC LIMIT 80)
SELECT event_id, event_type AS message, row_number() OVER (ORDER BY ts, event_id) AS line_no FROM l""",
)
def j4_recent(spark, sf):
    e = X.job_events(spark, sf).select("ts", "event_id", F.col("event_type").alias("message"))
    return J.recent_log(e).select("event_id", "message", "line_no")


def _jobs(spark, sf):
    """Jobs as folded, with creation and last-change times. One job in seven has no
    creation time, one in eleven a creation time far ahead."""
    e = X.job_events(spark, sf)
    times = e.groupBy("job_id").agg(F.min("ts").alias("first"), F.max("ts").alias("modified_at"))
    created = (
        F.when(F.col("job_id") % 7 == 0, F.lit(None).cast("timestamp"))
        .when(F.col("job_id") % 11 == 0, F.col("modified_at") + F.expr("INTERVAL 100 DAYS"))
        .otherwise(F.col("first") + F.make_dt_interval(F.col("job_id").cast("int") % 40))
    )
    return J.fold_jobs(e).join(times, "job_id").withColumn("created_at", created)


JOB_TIMES = f"""{FOLD},
tm AS (SELECT job_id, min(ts) AS first, max(ts) AS modified_at FROM job_events GROUP BY job_id),
jb AS (SELECT f.job_id, f.status, modified_at, CASE WHEN f.job_id % 7 = 0 THEN NULL WHEN f.job_id % 11 = 0 THEN modified_at + INTERVAL 100 DAYS
   ELSE first + to_days((f.job_id % 40)::INT) END AS created_at FROM fin f JOIN tm USING (job_id))"""
NOW = "2024-01-25 12:00:00"


@query(
    "j5_expired_jobs",
    f"""WITH RECURSIVE {JOB_TIMES}
SELECT job_id, 'web' AS profile FROM jb WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOURS
UNION ALL SELECT job_id, 'native' FROM jb WHERE status <> 'running' AND
  CASE WHEN created_at <= TIMESTAMP '{NOW}' + INTERVAL 5 MINUTES THEN created_at ELSE modified_at END <= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS""",
)
def j5(spark, sf):
    jobs, now = _jobs(spark, sf), F.to_timestamp_ntz(F.lit(NOW)).cast("timestamp")
    web = J.expired_jobs(jobs, now, "web").select("job_id", F.lit("web").alias("profile"))
    return web.unionByName(J.expired_jobs(jobs, now, "native").select("job_id", F.lit("native").alias("profile")))


@query(
    "j6_recover_interrupted",
    f"""WITH RECURSIVE {FOLD},
r AS (SELECT job_id, status, status IN ('queued', 'running') AS op, job_id % 3 = 0 AS proven, job_id % 2 = 0 AS paid FROM fin)
SELECT job_id, 'web' AS profile, CASE WHEN op THEN 'failed' ELSE status END AS status, CASE WHEN op THEN 'interrupted' END AS error_code, op AS retryable FROM r
UNION ALL SELECT job_id, 'native', CASE WHEN op AND proven THEN 'done' WHEN op AND paid THEN 'failed' WHEN op THEN 'queued' ELSE status END,
  CASE WHEN op AND NOT proven AND paid THEN 'task_interrupted' END, op AND NOT proven AND paid FROM r""",
)
def j6(spark, sf):
    jobs = J.fold_jobs(X.job_events(spark, sf)).withColumn(
        "kind", F.when(F.col("job_id") % 2 == 0, "pdf_translate").otherwise("ocr")
    )
    verdicts = jobs.filter("job_id % 5 <> 1 or job_id % 3 = 0").select(
        "job_id", F.when(F.col("job_id") % 3 == 0, "ok").otherwise("mismatch").alias("verdict")
    )
    both = [J.recover_interrupted(jobs, verdicts, p).withColumn("profile", F.lit(p)) for p in ("web", "native")]
    return both[0].unionByName(both[1])


WEB_TYPES = [e[0] for e in J.ERRORS] + ["ValueError"]
NATIVE_TYPES = [e[0] for e in J.NATIVE_ERRORS] + ["other"]


@query(
    "j7_classify_errors",
    f"""WITH {values_sql('web', ['t', 'code', 'retryable', 'hint'], J.ERRORS)}, {values_sql('native', ['t', 'code', 'retryable', 'hint'], J.NATIVE_ERRORS)},
e AS (SELECT event_id, 'own ' || event_type AS own, ({WEB_TYPES})[event_id % 6 + 1] AS wt, ({NATIVE_TYPES})[event_id % 7 + 1] AS nt FROM events)
SELECT event_id, 'web' AS profile, coalesce(code, 'task_failed') AS error_code, coalesce(retryable, TRUE) AS retryable, CASE WHEN code IS NULL THEN '查看运行日志中的失败细节。' ELSE coalesce(hint, own) END AS hint FROM e LEFT JOIN web ON t = wt
UNION ALL SELECT event_id, 'native', coalesce(code, 'task_failed'), coalesce(retryable, TRUE), CASE WHEN code IS NULL THEN '查看运行日志中的失败细节。' ELSE coalesce(hint, own) END FROM e LEFT JOIN native ON t = nt""",
)
def j7(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", F.concat(F.lit("own "), "event_type").alias("error_hint"))

    def typed(types, profile):
        t = F.element_at(F.array(*[F.lit(x) for x in types]), (F.col("event_id") % len(types) + 1).cast("int"))
        return J.classify_errors(e.withColumn("error_type", t), profile).select(
            "event_id", F.lit(profile).alias("profile"), "error_code", "retryable", "hint"
        )

    return typed(WEB_TYPES, "web").unionByName(typed(NATIVE_TYPES, "native"))


@query(
    "j8_public_view",
    """SELECT event_id, 'report-' || user_id || '.pdf' AS output, 'provider=' || event_type AS options FROM events""",
)
def j8(spark, sf):
    u = F.col("user_id").cast("string")
    jobs = X.table(spark, sf, "events").select(
        "event_id",
        F.lit("/data/jobs/1").alias("path"),
        F.col("user_id").alias("thread_id"),
        F.concat(F.lit("/data/jobs/"), u, F.lit("/out/report-"), u, F.lit(".pdf")).alias("output"),
        F.create_map(F.lit("provider"), F.col("event_type"), F.lit("api_key"), F.lit("k")).alias("options"),
    )
    pairs = F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return J.public_view(jobs).withColumn("options", F.array_join(pairs, ","))


SECRETS = ["the", "", "tion", "[RED", "er"]


@query(
    "j9_redact_secrets",
    """SELECT doc_id, replace(replace(replace(replace(text, 'the', '[REDACTED]'), 'tion', '[REDACTED]'), '[RED', '[REDACTED]'), 'er', '[REDACTED]') AS text FROM documents""",
)
def j9(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", J.redact(F.col("text"), SECRETS).alias("text"))


@query(
    "j10_progress_lines",
    f"""WITH {JOB_EVENTS},
e AS (SELECT job_id, event_id, ts, CASE event_id % 9 WHEN 0 THEN 'main' ELSE 'lane-' || (event_id % 4) END AS lane, (progress - 10) / 100 AS f FROM job_events),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id, lane ORDER BY ts DESC, event_id DESC) AS rn FROM e),
m AS (SELECT job_id, max((ts, event_id)) FILTER (WHERE lane = 'main') AS main_at, max((ts, event_id)) AS last_at FROM e GROUP BY job_id)
SELECT k.job_id, lane, event_id, greatest(0, least(1, f))::DOUBLE AS fraction FROM k JOIN m USING (job_id)
WHERE rn = 1 AND CASE WHEN lane = 'main' THEN (ts, event_id) = last_at ELSE main_at IS NULL OR (ts, event_id) > main_at END""",
)
def j10(spark, sf):
    n = F.col("event_id")
    e = X.job_events(spark, sf).select(
        "job_id", "event_id", "ts",
        F.when(n % 9 == 0, F.lit("main")).otherwise(F.concat(F.lit("lane-"), (n % 4).cast("string"))).alias("lane"),
        ((F.col("progress") - 10) / 100).alias("fraction"),
    )
    return J.progress_lines(e)


def _stream(spark, sf, name):
    """A table as a file stream: every parquet file that matches is one arrival."""
    schema = X.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf}/{name}.parque[t]")


@query("j11_stream_job_state", f"WITH RECURSIVE {FOLD} SELECT * FROM fin")
def j11(spark, sf):
    e = _stream(spark, sf, "events")
    status = F.expr(
        "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' "
        "WHEN 'purchase' THEN 'done' ELSE 'failed' END"
    )
    records = e.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        status.alias("status"), (F.col("value") > 150).alias("cancel"),
    )
    return SJ.current_state(SJ.run_available(SJ.stream_job_state(records), "update", "job-state"))


@query(
    "j12_stream_expiry",
    """WITH j AS (SELECT user_id * 10000 + day(ts) * 100 + hour(ts) AS job_id, date_trunc('hour', ts) AS created_at FROM events),
m AS (SELECT max(created_at) - INTERVAL 24 HOURS AS mark FROM j)
SELECT job_id, count(*) AS records FROM j, m WHERE created_at + INTERVAL 1 HOUR <= mark GROUP BY job_id""",
)
def j12(spark, sf):
    ts = F.col("ts").cast("timestamp")
    e = _stream(spark, sf, "events").select(
        (F.col("user_id") * 10000 + F.dayofmonth("ts") * 100 + F.hour("ts")).alias("job_id"),
        F.date_trunc("hour", ts).alias("created_at"),
    )
    return SJ.expired_now(SJ.run_available(SJ.stream_expiry(e), "update", "expiry")).select("job_id", "records")


@query(
    "j13_stream_inbox",
    """SELECT DISTINCT doc_id // 8 AS job_id, '/in/doc-' || (doc_id % 6) AS path FROM documents""",
)
def j13(spark, sf):
    d = _stream(spark, sf, "documents").select(
        F.expr("doc_id div 8").alias("job_id"),
        F.concat(F.lit("/in/doc-"), (F.col("doc_id") % 6).cast("string")).alias("path"),
        F.timestamp_seconds("doc_id").alias("arrived_at"),
    )
    return SJ.run_available(SJ.stream_inbox(d), "append", "inbox").select("job_id", "path")
