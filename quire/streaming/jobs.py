"""Live job state, expiry and inbox over Structured Streaming.

State is kept by Spark's own stateful operators under the shared checkpoint folder,
so a lost executor or a restart resumes where it was. Results of each micro-batch
are written to their own folder; rewriting a batch after a failure replaces it.
"""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quire.operators.jobs import fold_aggregates, fold_result
from quire.session import checkpoint_folder


def run_available(frame, mode, name):
    """Run a stream over what is there now; return a DataFrame of all emitted rows
    with the number of the batch that emitted them."""
    spark = frame.sparkSession
    base = f"{checkpoint_folder(spark)}/quire/{name}-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        frame.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    fields = list(frame.schema.fields) + [Ty.StructField("batch", Ty.LongType())]
    return spark.read.schema(Ty.StructType(fields)).parquet(out)


def stream_job_state(records):
    """Fold of ``fold_jobs`` kept live. Update mode emits a job whenever one of its
    three minima changes; late records are absorbed."""
    return records.groupBy("job_id").agg(*fold_aggregates())


def current_state(emitted):
    """Latest emitted aggregates per job as job states."""
    cols = ["_end", "_run", "_cancel"]
    last = emitted.groupBy("job_id").agg(F.max_by(F.struct(*cols), "batch").alias("_s"))
    return fold_result(last.select("job_id", *[F.col(f"_s.{c}").alias(c) for c in cols]))


def stream_expiry(records):
    """Creation time and number of records per job, kept live in update mode. There is
    no watermark: a record that arrives late counts like any other."""
    return records.groupBy("job_id").agg(F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("records"))


def expired_now(emitted, ttl="24 hours", sweep="1 hour"):
    """Jobs of :func:`stream_expiry` whose sweep hour ended ``ttl`` or more before the
    newest creation so far."""
    last = emitted.groupBy("job_id").agg(F.max_by(F.struct("created_at", "records"), "batch").alias("_l")).select("job_id", "_l.*")
    newest = emitted.agg(F.max("created_at").alias("_newest"))
    swept = last.withColumn("_end", F.window("created_at", sweep)["end"])
    # one row of one value: a bounded broadcast
    expired = swept.join(F.broadcast(newest), F.col("_end") <= F.col("_newest") - F.expr(f"INTERVAL {ttl}"))
    return expired.select(*last.columns)


def stream_inbox(arrivals):
    """Arriving files, each path of a job once, however late it or a repeat arrives. A
    batch is open until it is submitted, so paths are remembered without a horizon."""
    return arrivals.dropDuplicates(["job_id", "path"])
