"""Job-record operators. One busy job may hold a third of all records, so states
are commutative aggregates with map-side combine, and numbering goes by bucket.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.catalog import literal_table
from quire.functions.scale import number_rows

TERMINAL = ["done", "failed", "cancelled"]


def latest_state(events):
    """Last saved record per job."""
    last = F.max(F.struct("ts", "event_id", "status", "progress"))
    return events.groupBy("job_id").agg(last.alias("_l")).select(
        "job_id", F.col("_l.event_id").alias("event_id"), F.col("_l.status").alias("status"), F.col("_l.progress").alias("progress")
    )


def fold_aggregates():
    """First terminal, first running and first cancelling record of a job. They are
    minima, so arrival order does not matter and streams can keep them."""
    at = F.struct("ts", "event_id", "status")
    return [
        F.min(F.when(F.col("status").isin(TERMINAL), at)).alias("_end"),
        F.min(F.when(F.col("status") == "running", at)).alias("_run"),
        F.min(F.when(F.col("cancel"), at)).alias("_cancel"),
    ]


def fold_result(folded):
    """Job state from the three minima. A finished job ignores a later cancel; a
    cancel before the end is never undone and the later result is refused; a job
    that had not started is cancelled at once. A stored ``cancelled`` record ends its
    job without a result."""
    key = lambda c: F.struct(F.col(f"{c}.ts"), F.col(f"{c}.event_id"))
    ended, ran, cancelled = (F.col(c).isNotNull() for c in ("_end", "_run", "_cancel"))
    finished = ended & (~cancelled | (key("_end") <= key("_cancel")))
    waiting = ~ran | (key("_run") > key("_cancel"))
    status = (
        F.when(finished, F.col("_end.status"))
        .when(cancelled & (waiting | ended), "cancelled")
        .when(ran, "running")
        .otherwise("queued")
    )
    return folded.select(
        "job_id",
        status.alias("status"),
        ((cancelled & ~finished) | (finished & (F.col("_end.status") == "cancelled"))).alias("cancel_requested"),
        F.when(finished & (F.col("_end.status") != "cancelled"), F.col("_end.event_id")).alias("result_event"),
    )


def fold_jobs(events):
    return fold_result(events.groupBy("job_id").agg(*fold_aggregates()))


STATES = ["queued", "running", "done", "failed", "cancelled"]


def stage_defaults(events):
    """Stage from the status where none was given; progress cut to whole 0..100."""
    stage = F.coalesce("stage", F.when(F.col("status").isin(STATES), F.col("status")))
    whole = F.when(F.col("progress") >= 0, F.floor("progress")).otherwise(F.ceil("progress"))
    return events.withColumn("stage", stage).withColumn(
        "progress", F.greatest(F.lit(0), F.least(F.lit(100), whole)).cast("bigint")
    )


def step_progress(done, total):
    """20 plus up to 70 by steps done, halves to even."""
    return F.lit(20) + F.bround(F.lit(70.0) * done / total).cast("bigint")


def job_log(events):
    """Log lines with their number per job, minute by minute. Lines stay rows: a log is
    appended to for as long as the job lives."""
    return number_rows(events, ["job_id"], F.date_trunc("minute", F.col("ts")), ["ts", "event_id"], "line_no")


MAX_SERVICE_LINES = 80


def recent_log(events, n=MAX_SERVICE_LINES):
    """The last ``n`` lines of the whole service, oldest first."""
    last = events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)
    return last.withColumn("line_no", F.row_number().over(W.orderBy("ts", "event_id")).cast("bigint"))


def expired_jobs(jobs, now, profile="web", hours=24):
    """web: created more than 24 h ago. native: 24 h or more since creation, or since
    the last change where that is missing or over 5 minutes ahead; running jobs stay."""
    limit = F.expr(f"INTERVAL {int(hours)} HOURS")
    if profile == "web":
        return jobs.filter(F.col("created_at") < now - limit)
    known = F.when(F.col("created_at") <= now + F.expr("INTERVAL 5 MINUTES"), F.col("created_at"))
    return jobs.filter((F.coalesce(known, "modified_at") <= now - limit) & (F.col("status") != "running"))


def recover_interrupted(jobs, verdicts, profile="web"):
    """States after a restart. web: queued and running jobs fail and may be retried.
    native: done when the stored receipt matches the result, failed for a paid
    translation, otherwise queued again. ``verdicts``: job_id, verdict."""
    open_ = F.col("status").isin("queued", "running")
    if profile == "web":
        return jobs.select(
            "job_id",
            F.when(open_, "failed").otherwise(F.col("status")).alias("status"),
            F.when(open_, "interrupted").alias("error_code"),
            F.when(open_, F.lit(True)).otherwise(F.lit(False)).alias("retryable"),
        )
    joined = jobs.join(verdicts.select("job_id", F.col("verdict").alias("_v")), "job_id", "left")
    proven = open_ & F.coalesce(F.col("_v") == "ok", F.lit(False))
    paid = open_ & ~proven & (F.col("kind") == "pdf_translate")
    return joined.select(
        "job_id",
        F.when(proven, "done").when(paid, "failed").when(open_, "queued").otherwise(F.col("status")).alias("status"),
        F.when(paid, "task_interrupted").alias("error_code"),
        paid.alias("retryable"),
    )


# Error type, code, may be tried again, advice. Where the advice is missing
# the event brings its own.
ERRORS = [
    ("PdfInputRequired", "pdf_input_required", False, "请选择 PDF 文件，或切换到适合该文件类型的转换路径。"),
    ("OcrInputRequired", "ocr_input_required", False, "请选择 PDF、PNG、JPG、WEBP 或 TIFF 文件。"),
    ("NoUploadedFiles", "file_required", False, "重新选择文件后再提交。"),
    ("ProviderNotConfigured", "missing_provider", True, "在 .env 中配置对应 API key 后重启服务。"),
    ("MissingDependency", "missing_dependency", True, None),
]
NATIVE_ERRORS = [
    ("invalidFile", "invalid_file", True, "确认文件没有损坏，并与所选输入格式一致。"),
    ("invalidOption", "invalid_option", True, "修改任务参数后重新运行。"),
    ("processing", "native_processing_failed", True, "检查输入文件后重试；问题持续时可保留日志用于反馈。"),
    ("processingLimit", "processing_limit_exceeded", True, None),
    ("provider", "translation_provider_failed", True, "检查网络、API Key、服务余额和服务商状态后重试。"),
    ("layoutOverflow", "translation_layout_overflow", True, "检查标记区域，或使用已保存的译文生成纯译文 PDF，无需再次调用翻译服务。"),
]
DEFAULT_ERROR = ("task_failed", True, "查看运行日志中的失败细节。")


def classify_errors(events, profile="web"):
    """Code, retry flag and advice of each error type; unknown types get the default. Advice
    that the catalogue leaves open comes from the event's own ``error_hint``, where it has one."""
    rows = ERRORS if profile == "web" else NATIVE_ERRORS
    known = literal_table(events.sparkSession, "error_type string, _code string, _retry boolean, _hint string", rows)
    own = F.col("error_hint") if "error_hint" in events.columns else F.lit(None).cast("string")
    return events.join(F.broadcast(known), "error_type", "left").select(
        *events.columns,
        F.coalesce("_code", F.lit(DEFAULT_ERROR[0])).alias("error_code"),
        F.coalesce("_retry", F.lit(DEFAULT_ERROR[1])).alias("retryable"),
        F.when(F.col("_code").isNull(), F.lit(DEFAULT_ERROR[2])).otherwise(F.coalesce("_hint", own)).alias("hint"),
    )


def public_view(jobs):
    """What a client may see: no path or thread, output as a bare name, no key in
    the options map."""
    out = jobs.drop("path", "thread_id").withColumn("output", F.regexp_extract("output", r"([^/]+)/*$", 1))
    return out.withColumn("options", F.map_filter("options", lambda k, v: k != "api_key"))


REDACTED = "[REDACTED]"


def redact(col, secrets):
    """Every known secret replaced, one after the other; empty ones are skipped.
    ``secrets`` is the short list of configured keys."""
    for secret in secrets:
        if secret:
            col = F.replace(col, F.lit(secret), F.lit(REDACTED))
    return col


def progress_lines(events, jobs=None):
    """Current lines per running job: the latest of each lane after the last
    ``main`` line, or that line alone. Aggregated per (job, lane) first; the window
    then sees a job's handful of lanes. ``jobs`` (job_id, status) tells which jobs run;
    lines of all others are left out."""
    if jobs is not None:
        events = events.join(jobs.filter("status = 'running'").select("job_id"), "job_id", "left_semi")
    bounded = F.when(F.isnan("fraction") | F.abs("fraction").isin(float("inf")), F.lit(0.0)).otherwise(F.col("fraction"))
    lanes = events.groupBy("job_id", "lane").agg(
        F.max(F.struct("ts", "event_id", bounded.alias("fraction"))).alias("_l")
    )
    job = W.partitionBy("job_id")
    is_main = F.col("lane") == "main"
    main = F.max(F.when(is_main, F.col("_l"))).over(job)
    newest = F.max("_l").over(job)
    return (
        lanes.withColumn("_main", main)
        .withColumn("_new", newest)
        .filter(
            F.when(is_main, F.col("_l") == F.col("_new")).otherwise(
                F.col("_main").isNull() | (F.struct("_l.ts", "_l.event_id") > F.struct("_main.ts", "_main.event_id"))
            )
        )
        .select(
            "job_id", "lane", F.col("_l.event_id").alias("event_id"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_l.fraction")).alias("fraction"),
        )
    )
