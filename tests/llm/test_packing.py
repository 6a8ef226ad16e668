"""Packing: tokens against the tokenizer, sequences against the lower bound."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.common import stored
from quire.llm.packing import WordEncoder, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_pieces(rows, limit=2048):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    out = set()
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), limit)):
            part = ids[start : start + limit]
            out.add((doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def sequences(rows, capacity):
    """Number of sequences; fails unless each is gapless from 0 and short enough."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = pack_documents(docs, PATH).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == plain_pieces([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sequences(got, 2048) <= math.ceil(sum(r["length"] for r in got) / 2048) + 2


@pytest.mark.parametrize("lengths", [[1] * 700, [51] * 90 + [49] * 90, [100] * 5, [34] * 99, "mixed"])
def test_lengths(spark, lengths):
    rng = random.Random(1)
    sizes = [min(100, int(rng.paretovariate(0.9) * 4)) for _ in range(900)] if lengths == "mixed" else lengths
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "uid long, length long")
    got = pack(stored(rows, "test-pack"), 100).collect()
    assert sorted(r["length"] for r in got) == sorted(sizes)
    best = {"mixed": math.ceil(sum(sizes) / 100) + 2}.get(str(lengths)) or {700: 7, 180: 90, 5: 5, 99: 50}[len(sizes)]
    assert sequences(got, 100) <= best


def test_odd_words(spark):
    rng = random.Random(2)
    bits = ["It's", "don'T", "İ", "ΑΣ", "é", "é", "ﬁ", "1234", "a1b", "...", "\U0010fffd", "<|endoftext|>", "x" * 50, "Ünï.", "a,b,", "ß", "²", "漢字", "\x85", "　", "\x1c"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(12))) for i in range(800)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == plain_pieces(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "word"), (4, "same row"), (4, "same row"), (5, "many words " * 20_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, uid string, length int")
    got = pack_documents(df, PATH).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).collect()
    assert len(got) == len(rows) - 1 + math.ceil(40_001 / 2048) and sequences(got, 2048) == 20
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_folding_before_the_tokenizer():
    rng = random.Random(4)
    bits = ["J̌", "H̱", "K", "'S", "x's.", "é. ", "x. ", "y, ", ". ", ",, ", "\x01. ", "'. ", "A, ", "end.\n", "ab̸", "ÀB$$", "<|endoftext|>", "#1"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(8)) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert WordEncoder(PATH).encode(texts) == want
    small = WordEncoder(PATH, room=50)
    assert [small.encode([t])[0] for t in texts[:300]] == want[:300] and len(small.words) < 100
    assert small.encode([]) == [] and small.encode(["", " "]) == [b"", b""]


def test_jobs_do_not_grow_with_the_sizes(spark):
    """The rounds of earlier versions took dozens of jobs, which many partitions made slow."""
    rows = spark.createDataFrame([(i, 1 + i % 90) for i in range(2000)], "uid long, length long")
    rows = stored(rows, "test-pack")
    spark.sparkContext.setJobGroup("packing-jobs", "")
    got = pack(rows, 100).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("packing-jobs"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12 and sequences(got, 100) <= math.ceil(sum(r["length"] for r in got) / 100) + 8
