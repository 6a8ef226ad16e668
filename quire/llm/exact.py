"""Exact deduplication as a stateful stream.

Files of a table arrive as micro-batches. The stream groups by the SHA-256 of the
normalised text; its keyed state lives in RocksDB on the executors' disks, is
checkpointed to the shared folder and never expires. Per digest the state holds how many
rows came, the best of them (most code points, then smallest id) and where that row's
content lies (file and block offset, row id). Each micro-batch writes its rows and the
states it changed, so a repeated batch replaces what it wrote.

A digest is not taken on trust: every row whose digest was hit more than once is compared,
byte by byte, with the text of the row that stays, which is fetched by its locator. Rows
that differ in spite of equal digests are grouped by their full text instead.

Counts are added up before the shuffle, so a text that makes a third of all rows costs one
row per task. Nulls: a null text counts as empty, and empty texts equal each other; a null
``doc_id`` sorts after every other. Repeated rows are rows: they count, and exactly one
of them stays. Extra columns are ignored. An empty table gives no rows.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import new_folder, stored

#: State on disk; no space is set aside in advance, since partitions may be many and small.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Deleted before texts are compared.
BLANK = r"[\x20\x09-\x0D]+"
LAST = 2**63 - 1


def _best():
    """Sort key of the row that stays: the smallest struct wins."""
    return F.struct(
        (-F.col("n_points")).alias("less"),
        F.coalesce("doc_id", F.lit(LAST)).alias("rank_id"),
        F.col("row_id"),
        F.col("place"),
    )


def sha256_digest(text):
    return F.sha2(text, 256)


def _pattern(path):
    """``path`` as a pattern that matches it alone: streams take a single file only that way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _rows(reader, path, digest):
    """Identity, locator and digest of each row of the Parquet table at ``path``, with its text."""
    table = reader.parquet(path).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.concat_ws(":", "_metadata.file_path", "_metadata.file_block_start").alias("place"),
        F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("row_id"),
    )
    plain = table.withColumn("plain", F.regexp_replace("text", BLANK, ""))
    return plain.select(
        "row_id", "doc_id", digest(F.col("plain")).alias("digest"), "place", F.length("text").cast("long").alias("n_points"), "plain"
    )


def _schema(spark, path):
    types = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    return T.StructType([T.StructField(c, types[c]) for c in ("doc_id", "text")])


def stream_states(spark, path, files_per_batch=8, digest=sha256_digest):
    """Stream the Parquet table at ``path`` to its end; the last state of every digest.

    Columns: ``digest, n_rows, best`` (``best`` holds identifier and locator).
    """
    folder = new_folder(spark, "exact-dedup")
    source = spark.readStream.schema(_schema(spark, path)).option("maxFilesPerTrigger", files_per_batch)
    state = _rows(source, _pattern(path), digest).groupBy("digest").agg(F.count("*").alias("n_rows"), F.min(_best()).alias("best"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}"))
            .start()
        )
        query.awaitTermination()
        batches = query.lastProgress is not None and query.lastProgress["batchId"] >= 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not batches:
        return spark.createDataFrame([], state.schema)
    # a digest's state only grows from batch to batch: its largest count is its last
    changed = spark.read.schema(state.schema).parquet(f"{folder}/state")
    return changed.groupBy("digest").agg(F.max("n_rows").alias("n_rows"), F.min("best").alias("best"))


def deduplicate(spark, path, files_per_batch=8, digest=sha256_digest):
    """One row per row of the table at ``path``.

    Columns: ``row_id, doc_id, keep_id, group_size, kept, digest``.
    """
    states = stream_states(spark, path, files_per_batch, digest)
    rows = _rows(spark.read, path, digest).join(states, "digest")
    hit = F.col("n_rows") > 1
    rows = stored(rows.withColumn("plain", F.when(hit, F.col("plain"))), "exact-rows")
    stays = F.col("row_id") == F.col("best.row_id")
    stayed = rows.filter(hit & stays).select("digest", F.col("plain").alias("stays_plain"))
    # full bytes decide on every hit
    differ = (
        rows.filter(hit & ~stays).select("digest", "plain").join(stayed, "digest")
        .filter(F.col("plain") != F.col("stays_plain")).select("digest").distinct()
    )
    differ = stored(differ, "exact-collisions")
    out = ("row_id", "doc_id", "best", "n_rows", "digest")
    if differ.isEmpty():
        told = rows.select(*out)
    else:
        again = rows.join(differ, "digest", "left_semi").drop("n_rows", "best")
        groups = again.groupBy("digest", "plain").agg(F.count("*").alias("n_rows"), F.min(_best()).alias("best"))
        told = rows.join(differ, "digest", "left_anti").select(*out).unionByName(again.join(groups, ["digest", "plain"]).select(*out))
    rank = F.col("best.rank_id")
    return told.select(
        "row_id", "doc_id", F.when(rank != LAST, rank).alias("keep_id"), F.col("n_rows").alias("group_size"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept"), "digest",
    )


def distinct_rows(docs, files_per_batch=8):
    """``docs`` without the rows that :func:`deduplicate` drops; same columns.

    The rows are written to the shared folder first, because a stream reads files.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "exact-input")
    docs.write.parquet(path)
    kept = deduplicate(spark, path, files_per_batch).filter("kept").select(F.col("row_id").alias("_row_id"))
    rows = spark.read.schema(docs.schema).parquet(path)
    place = F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("_row_id")
    return rows.select("*", place).join(kept, "_row_id", "left_semi").select(*docs.columns)
