"""Passage removal against a plain version."""

import hashlib
import random
import re
from collections import Counter

import pytest

from quire.llm.common import hash_ranges
from quire.llm.substring import _seed_blocks, recurring, remove_repeats, sliced

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def rows_of(df):
    return sorted(((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in df.collect()), key=str)


def want_of(rows):
    return sorted(((i is None, i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows]))), key=str)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = want_of(rows)
    assert any(w[3] for w in want)
    assert rows_of(remove_repeats(docs)) == want


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200)] + [["x", "y", "z"] * 20, ["same"] * 90]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(5)):
            text += [word() for _ in range(rng.randrange(60))]
            p = rng.choice(passages)
            a = rng.randrange(0, 10)
            text += p[a:] if rng.random() < 0.4 else p
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    got = rows_of(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows=7))
    assert got == want_of(rows)


def test_seeds_without_windows(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(30)) + " " + shared + " " + " ".join(f"x{i}_{k}" for k in range(30))) for i in range(4)]
    assert rows_of(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == want_of(rows)


def test_edge_rows(spark):
    words = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"v{i % 70_000}" for i in range(100_000))
    rows = [(1, None), (2, ""), (None, words), (4, words), (4, words), (5, " \n "), (6, long), (7, "é\x85ü " * 50)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, slice string, keys int")
    assert rows_of(remove_repeats(df)) == want_of(rows)
    assert remove_repeats(df.limit(0)).count() == 0


def test_blocks_do_not_follow_the_partitions(spark, tmp_path):
    """With a range per partition, slices times partitions blocks met."""
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(i, text) for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder = str(tmp_path / "documents")
    df.write.parquet(folder)
    docs = sliced(spark.read.parquet(folder), 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    counts = []
    for n in (8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        counts.append(recurring(_seed_blocks(docs, 35, 8, hash_ranges(docs))).count())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert counts[0] == counts[1] <= 16 * 16
