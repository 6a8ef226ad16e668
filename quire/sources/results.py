"""Results: writing, manifests, fingerprints and their verification."""

import re
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

# Signs that stand as %XX in the name of a partition's folder, and its name without a value.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Bytes of text that a reading task hands over at once.
READ_BYTES = 1 << 20


def _folder(column, value):
    shown = NO_VALUE if value is None or value == "" else ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", str(value))
    return f"{column}={shown}"


def _uri(spark, path):
    """The path as a URI that tasks can open through Arrow, or none for stores it does not know."""
    from pyarrow import fs

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toString()
    uri = re.sub(r"^file:/+", "file:///", full)
    try:
        fs.FileSystem.from_uri(uri)
    except Exception:  # noqa: BLE001 - an unknown scheme or a missing client: Spark's own writer does it
        return None
    return uri


def _write_files(df, path, uri, mode):
    """One file per row, each put in place whole; the manifest that names them is committed last.

    Rows that share both keys are numbered, so a task that runs again writes the same files.
    """
    df.limit(0).write.mode(mode).partitionBy("job_id", "name").text(path)
    number = F.row_number().over(W.partitionBy("job_id", "name").orderBy("text"))
    tag = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            files = []
            for job, name, text, n in zip(*[c.to_pylist() for c in batch.columns]):
                folder = f"{_folder('job_id', job)}/{_folder('name', name)}"
                files.append(f"{folder}/part-{n:05d}-{tag}.txt")
                store.create_dir(f"{root}/{folder}", recursive=True)
                draft = f"{root}/{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(((text or "") + "\n").encode())
                store.move(draft, f"{root}/{files[-1]}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(files, pa.string())], ["job_id", "name", "file"])

    typed = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("job_id", "name"))
    df.withColumn("_n", number).mapInArrow(run, f"{typed}, file string").write.mode("append").parquet(f"{path}/_manifest")


def write_documents(df, path, layout="table", mode="overwrite"):
    """Write one text result per document (job_id, name, text).

    ``table``: parquet rows, for corpora. ``files``: one folder per result, each
    holding a text file, for results a person downloads. Rows, and the manifest of the
    files, go through the job committer, and a file appears whole, so readers never see
    half a result.
    """
    if layout == "files":
        rows = df.select("job_id", "name", "text")
        uri = None if mode == "ignore" else _uri(df.sparkSession, path)
        if uri:
            _write_files(rows, path, uri, mode)
        else:
            rows.write.mode(mode).partitionBy("job_id", "name").text(path)
    else:
        df.select("job_id", "name", "text").write.mode(mode).parquet(path)


def _read_files(manifest, uri, keys):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)

        def rows(batch, start, texts):
            part = batch.slice(start, len(texts))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["job_id", "name", "text"])

        for batch in batches:
            start, texts, size = 0, [], 0
            for file in batch.column(2).to_pylist():
                with store.open_input_stream(f"{root}/{file}") as source:
                    data = source.read()
                texts.append(data.decode("utf-8", "replace").removesuffix("\n"))
                size += len(data)
                if size >= READ_BYTES:
                    yield rows(batch, start, texts)
                    start, texts, size = start + len(texts), [], 0
            if texts:
                yield rows(batch, start, texts)

    named = manifest.select(F.col("job_id").cast("bigint"), F.nullif(F.col("name").cast("string"), F.lit("")).alias("name"), "file")
    return named.mapInArrow(run, f"{keys}, text string")


def read_documents(spark, path, layout="files"):
    """Results as ``write_documents`` left them (job_id, name, text). In the files layout the
    two keys are names of folders and each text is one file, whose last line break is the
    writer's. Tasks open the files that the manifest names; without one Spark lists them."""
    if layout != "files":
        return spark.read.parquet(path)
    keys = "job_id bigint, name string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return _read_files(spark.read.parquet(f"{path}/_manifest"), _uri(spark, path), keys)
    return (
        spark.read.schema(f"value string, {keys}").text(path, wholetext=True)
        .select("job_id", "name", F.regexp_replace("value", r"\n\z", "").alias("text"))
    )


# Name of the bundle when a job has several outputs.
BUNDLES = {
    "convert": "converted-files.zip",
    "extract_markdown": "markdown-files.zip",
    "ocr": "ocr-files.zip",
}


def bundle_manifest(outputs):
    """One output stays itself, several become one named bundle. The manifest is
    one row per job; members stay rows of ``outputs``."""
    per_job = outputs.groupBy("job_id", "kind").agg(
        F.count(F.lit(1)).alias("members"), F.min("name").alias("_only"), F.sum("size").alias("size")
    )
    named = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in BUNDLES.items()], F.lit("files.zip"))
    return per_job.select(
        "job_id",
        "kind",
        F.when(F.col("members") == 1, F.col("_only")).otherwise(named).alias("artifact"),
        "members",
        "size",
    )


SAMPLE_BYTES = 64 * 1024


def result_fingerprint(content, sample=SAMPLE_BYTES):
    """(byte_count, sample_sha256): the whole file up to twice the sample size,
    else its first and last ``sample`` bytes."""
    size = F.octet_length(content)
    ends = F.concat(F.substring(content, 1, sample), F.substring(content, -sample, sample))
    return F.struct(
        size.cast("bigint").alias("byte_count"),
        F.sha2(F.when(size <= 2 * sample, content).otherwise(ends), 256).alias("sample_sha256"),
    )


def source_fingerprint(content):
    return F.sha2(content, 256)


def verify_results(manifest, actual):
    """Stored receipts against recomputed fingerprints. ``pages`` of ``actual`` is
    NULL for results that have no pages."""
    valid = (F.col("m.byte_count") >= 0) & F.col("m.sample_sha256").rlike("^[0-9A-Fa-f]{64}$")
    same = F.col("m.byte_count").eqNullSafe(F.col("a.byte_count")) & F.lower("m.sample_sha256").eqNullSafe(
        F.col("a.sample_sha256")
    )
    verdict = (
        F.when(F.col("m.output").isNull(), "no_receipt")
        .when(~F.coalesce(valid, F.lit(False)), "invalid_receipt")
        .when(F.col("a.output").isNull(), "missing")
        .when(F.coalesce(F.col("a.pages") < 1, F.lit(False)), "no_pages")
        .when(same, "ok")
        .otherwise("mismatch")
    )
    return (
        manifest.alias("m")
        .join(actual.alias("a"), F.col("m.output") == F.col("a.output"), "full_outer")
        .select(F.coalesce("m.output", "a.output").alias("output"), verdict.alias("verdict"))
    )


def resolve_path(col):
    """Absolute path without empty, ``.`` and ``..`` segments."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(col, "/"),
        none,
        lambda acc, seg: F.when(seg.isin("", "."), acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def protect_originals(results, inputs, existing):
    """Verdict per result. A running job may not write onto one of its inputs; a
    restored job, whose inputs are unknown, may only write to a free path."""
    target = results.withColumn("_path", resolve_path(F.col("destination")))
    own = inputs.select("job_id", resolve_path(F.col("path")).alias("_path"), F.lit(True).alias("_own")).distinct()
    taken = existing.select(resolve_path(F.col("path")).alias("_path"), F.lit(True).alias("_taken")).distinct()
    running = target.filter(~F.col("restored")).join(own, ["job_id", "_path"], "left")
    restored = target.filter("restored").join(taken, "_path", "left")
    return running.select(
        "job_id", "destination", F.when(F.col("_own"), "original_file").otherwise("ok").alias("verdict")
    ).unionByName(
        restored.select(
            "job_id", "destination", F.when(F.col("_taken"), "existing_file").otherwise("ok").alias("verdict")
        )
    )


# Name tokens an engine gives its output, in order of preference.
OUTPUT_TOKENS = {"bilingual": ["dual", "bilingual"], "translated": ["mono", "translated", "zh"]}


def pick_engine_output(inventory, runs):
    """Newest file of a run with the stem prefix, written at or after the start
    less one second; a preferred token outranks recency. One ``min`` per run."""
    stem = F.lower(T.stem(F.col("name")))

    def rank(mode):
        tokens = OUTPUT_TOKENS[mode]
        out = F.lit(len(tokens))
        for i, token in reversed(list(enumerate(tokens))):
            out = F.when(F.contains(stem, F.lit(token)), F.lit(i)).otherwise(out)
        return out

    token_rank = F.when(F.col("mode") == "bilingual", rank("bilingual")).otherwise(rank("translated"))
    live = inventory.join(runs, "run_id").filter(
        F.col("name").startswith(F.col("stem"))
        & (T.suffix(F.col("name")) == ".pdf")
        & (F.col("since").isNull() | (F.col("mtime") >= F.col("since") - 1))
    )
    best = F.min(F.struct(token_rank.alias("r"), (-F.col("mtime")).alias("m"), F.col("name").alias("name")))
    return live.groupBy("run_id").agg(best.alias("_b"), F.count(F.lit(1)).alias("candidates")).select(
        "run_id", F.col("_b.name").alias("picked"), "candidates"
    )


def order_inputs(files, order):
    """Sort keys of a job's inputs: upload position, unknown names after all known
    ones, ties by name. ``order`` has (job_id, name, ord); positions are 0-based."""
    known = order.select("job_id", F.lower("name").alias("_k"), (F.col("ord") - 1).alias("_pos")).groupBy(
        "job_id", "_k"
    ).agg(F.max("_pos").alias("_pos"))
    size = order.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        files.withColumn("_k", F.lower("name"))
        .join(known, ["job_id", "_k"], "left")
        .join(size, "job_id", "left")
        .withColumn("sort_pos", F.coalesce("_pos", "_n", F.lit(0)).cast("bigint"))
        .drop("_k", "_pos", "_n")
    )
