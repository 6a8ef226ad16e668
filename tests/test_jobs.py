"""Job records in batch and as streams."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import jobs as J
from quire.streaming import jobs as SJ

RECORD = "job_id long, event_id long, ts timestamp, status string, progress double, cancel boolean"


def records(spark, rows):
    df = spark.createDataFrame(
        [(j, i, s, c) for i, (j, s, c) in enumerate(rows)], "job_id long, event_id long, status string, cancel boolean"
    )
    return df.select("job_id", "event_id", F.timestamp_seconds("event_id").alias("ts"), "status", F.lit(0.0).alias("progress"), "cancel")


def test_cancel_is_sticky(spark):
    rows = [
        (1, "queued", False), (1, "queued", True), (1, "running", False), (1, "done", False),
        (2, "running", False), (2, "done", False), (2, "running", True),
        (3, "running", False), (3, "running", True), (3, "running", False),
        (4, "running", False), (4, "running", True), (4, "done", False),
        (5, "queued", False),
    ]
    got = {r.job_id: (r.status, r.cancel_requested, r.result_event) for r in J.fold_jobs(records(spark, rows)).collect()}
    assert got == {1: ("cancelled", True, None), 2: ("done", False, 5), 3: ("running", True, None), 4: ("cancelled", True, None), 5: ("queued", False, None)}


def test_fold_does_not_depend_on_arrival_order(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 5), rng.choice(["queued", "running", "done", "failed"]), rng.random() < 0.2) for _ in range(60)]
    df = records(spark, rows)
    base = sorted(J.fold_jobs(df).collect())
    for seed in range(3):
        assert sorted(J.fold_jobs(df.orderBy(F.rand(seed)).repartition(7)).collect()) == base


def test_expiry_profiles(spark):
    rows = [
        (1, "done", "2024-01-01 00:00:00", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:00:00", "2024-01-01 00:00:00"),
        (3, "done", None, "2024-01-01 00:00:00"), (4, "done", "2024-02-01 00:00:00", "2024-01-01 00:00:00"), (5, "done", "2024-01-02 12:00:00", "2024-01-02 12:00:00"),
    ]
    df = spark.createDataFrame(rows, "job_id long, status string, c string, m string").select(
        "job_id", "status", F.col("c").cast("timestamp").alias("created_at"), F.col("m").cast("timestamp").alias("modified_at")
    )
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert {r.job_id for r in J.expired_jobs(df, now, "web").collect()} == set()
    assert {r.job_id for r in J.expired_jobs(df, now, "native").collect()} == {1, 3, 4}
    later = F.lit("2024-01-02 00:00:01").cast("timestamp")
    assert {r.job_id for r in J.expired_jobs(df, later, "web").collect()} == {1, 2}


def test_halves_round_to_even(spark):
    df = spark.createDataFrame([(1, 4), (1, 20), (3, 20)], "d int, t int")
    assert [r.p for r in df.select(J.step_progress(F.col("d"), F.col("t")).alias("p")).collect()] == [38, 24, 30]


def test_redaction_skips_empty_secrets(spark):
    df = spark.createDataFrame([("key=abc abc",)], "t string")
    assert df.select(J.redact(F.col("t"), ["", "abc"]).alias("t")).first().t == "key=[REDACTED] [REDACTED]"


def test_main_line_replaces_lanes(spark):
    rows = [(1, "a", 0.5), (1, "b", 2.0), (1, "main", 0.1), (2, "main", 0.1), (2, "a", float("nan")), (3, "b", 0.25)]
    df = spark.createDataFrame([(j, i, l, f) for i, (j, l, f) in enumerate(rows)], "job_id long, event_id long, lane string, fraction double")
    got = sorted((r.job_id, r.lane, r.fraction) for r in J.progress_lines(df.withColumn("ts", F.timestamp_seconds("event_id"))).collect())
    assert got == [(1, "main", 0.1), (2, "a", 0.0), (3, "b", 0.25)]
    jobs = spark.createDataFrame([(1, "done"), (2, "running"), (4, "running")], "job_id long, status string")
    running = J.progress_lines(df.withColumn("ts", F.timestamp_seconds("event_id")), jobs)
    assert [(r.job_id, r.lane) for r in running.collect()] == [(2, "a")]


def test_errors_carry_advice(spark):
    events = spark.createDataFrame([("MissingDependency", "install it"), ("NoUploadedFiles", "own"), ("Other", "own"), (None, None)], "error_type string, error_hint string")
    got = {r.error_type: (r.error_code, r.hint) for r in J.classify_errors(events).collect()}
    assert got["MissingDependency"] == ("missing_dependency", "install it") and got["NoUploadedFiles"][1] != "own"
    assert got["Other"] == got[None] == ("task_failed", "查看运行日志中的失败细节。")


def test_log_of_one_busy_job(spark):
    e = spark.range(3000).select(F.lit(1).alias("job_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 11).alias("ts"))
    assert [r.line_no for r in J.job_log(e).orderBy("event_id").collect()] == list(range(1, 3001))
    assert [r.event_id for r in J.recent_log(e).orderBy("line_no").collect()] == list(range(2920, 3000))


@pytest.fixture()
def slices(spark, sf_dir, tmp_path):
    """The events dealt out to eight files, so that later files hold late records."""
    path = str(tmp_path / "events")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(8):
        e.filter(F.col("event_id") % 8 == i).coalesce(1).write.mode("append").parquet(path)
    return path, e.schema


def events_as_records(e):
    return e.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.expr("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END").alias("status"),
        (F.col("value") > 150).alias("cancel"),
    )


def test_stream_fold_equals_batch_fold(spark, slices):
    path, schema = slices
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    emitted = SJ.run_available(SJ.stream_job_state(events_as_records(stream)), "update", "test-state")
    assert emitted.select("batch").distinct().count() > 1
    batch = J.fold_jobs(events_as_records(spark.read.parquet(path)))
    assert sorted(SJ.current_state(emitted).collect()) == sorted(batch.collect())


def test_stream_expiry_counts_late_jobs(spark, tmp_path):
    path = str(tmp_path / "jobs")
    for day in (4, 1, 3, 2):  # the newest arrives first
        spark.range(3).select(
            (F.col("id") + day * 10).alias("job_id"), F.lit(f"2024-01-0{day} 10:00:00").cast("timestamp").alias("created_at")
        ).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = SJ.expired_now(SJ.run_available(SJ.stream_expiry(stream), "update", "test-expiry"))
    # Newest creation is day 4, 10:00; hours closed 24 h before that are expired.
    assert sorted(r.job_id for r in got.collect()) == [10, 11, 12, 20, 21, 22]


def test_stream_inbox_drops_repeats_over_batches(spark, tmp_path):
    path = str(tmp_path / "inbox")
    for i in range(3):
        spark.range(4).select(
            F.lit(1).alias("job_id"), F.concat(F.lit("/in/"), ((F.col("id") + i) % 5).cast("string")).alias("path"),
            F.timestamp_seconds(F.lit(10**9 - i * 10**7)).alias("arrived_at"),
        ).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = SJ.run_available(SJ.stream_inbox(stream), "append", "test-inbox")
    assert sorted(r.path for r in got.collect()) == [f"/in/{i}" for i in range(5)]


def test_stored_cancelled_record_ends_its_job(spark):
    rows = [(1, 1, "queued"), (1, 2, "cancelled"), (2, 1, "running"), (2, 2, "cancelled"), (2, 3, "done"), (3, 1, "done"), (3, 2, "cancelled")]
    e = spark.createDataFrame([(j, i, s, False) for j, i, s in rows], "job_id int, event_id int, status string, cancel boolean")
    got = {r.job_id: (r.status, r.cancel_requested, r.result_event) for r in J.fold_jobs(e.withColumn("ts", F.timestamp_seconds("event_id"))).collect()}
    assert got == {1: ("cancelled", True, None), 2: ("cancelled", True, None), 3: ("done", False, 1)}


def test_progress_covers_every_job(spark, sf_dir):
    from quire import plans
    from quire.plans import fixtures as X

    jobs = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id")).distinct()
    assert jobs.join(plans.QUERIES["j10_progress_lines"](spark, sf_dir), "job_id", "left_anti").count() == 0
