"""Streaming exact deduplication against a plain version; collisions; several batches."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm.exact import deduplicate, distinct_rows

BLANK = re.compile(r"[\x20\x09-\x0D]")
BIG = 2**62


def plain(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), BIG if d is None else d, d))
    return sorted(((d, min(groups[BLANK.sub("", t or "")])[2], len(groups[BLANK.sub("", t or "")])) for d, t in rows), key=str)


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("digest", ["sha", "weak"])
def test_batches_and_collisions(spark, tmp_path, digest):
    rows = [(i, ["a b c", "abc", "a bc  ", "x", None, "", " \n", "xy", "yx", f"own {i}"][i * 7 % 10]) for i in range(200)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(path)
    # a digest that collides: only the full bytes tell the texts apart
    options = {"digest": lambda t: F.length(t).cast("string")} if digest == "weak" else {}
    result = deduplicate(spark, path, files_per_batch=2, **options)
    assert got(result) == plain(rows)
    kept = result.filter("kept").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({k for _, k, _ in plain(rows)})


def test_edge_rows(spark, tmp_path):
    rows = [(None, "z"), (1, None), (2, ""), (3, "z"), (3, "z"), (4, "q" * 1_000_000), (5, " " * 10 + "q" * 1_000_000)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "doc_id long, text string, digest string, n_rows int")
    path = str(tmp_path / "edge")
    df.write.parquet(path)
    result = deduplicate(spark, path)
    assert got(result) == plain(rows)
    assert result.filter("kept").count() == 3
    left = distinct_rows(df)
    assert left.columns == df.columns and sorted(left.select("doc_id").toPandas().doc_id.tolist()) == [1, 3, 5]
    empty = str(tmp_path / "empty")
    df.limit(0).write.parquet(empty)
    assert deduplicate(spark, empty).count() == 0 and distinct_rows(df.limit(0)).count() == 0
