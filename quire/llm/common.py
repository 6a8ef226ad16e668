"""Shared folder, worker caches and default paths of this subpackage."""

import sys
import types
import uuid

from pyspark.sql import functions as F

TEXT_SCHEMA = "doc_id long, text string"


def shared_folder(spark):
    """A folder every executor reaches: ``spark.checkpoint.dir`` of the session.

    Where that is unset (a local session) it is a folder beside the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch"
    return folder.rstrip("/")


def new_folder(spark, name):
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df, name):
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_ranges(docs, text_col="text", each=64 << 20, least=16):
    """Into how many ranges the hashes of all texts are dealt: one for ``each`` bytes of text.

    Slices send a block to every range, so the number must not follow the number of
    partitions; the texts bound what one range holds.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).collect()[0][0] or 0
    return max(least, -(-size // each))


def worker_cache(name):
    """A dict that lives as long as its Python worker.

    Functions of this package travel to executors by value, so module globals do not
    outlive a task; a module made by hand does.
    """
    module = sys.modules.setdefault("_quire_worker", types.ModuleType("_quire_worker"))
    return module.__dict__.setdefault(name, {})
