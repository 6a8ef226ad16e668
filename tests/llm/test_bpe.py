"""Byte-level encoding against tiktoken, and exact round trips."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from quire.llm.bpe import round_trip_digests
from quire.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def got(rows):
    return sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows.collect()), key=str)


def test_registered_columns(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got(QUERIES["op7_byte_bpe_round_trip"](spark, sf_dir)) == sorted(((r["doc_id"], *digests(reference, r["text"])) for r in docs), key=str)


def test_odd_texts(spark, reference):
    rng = random.Random(6)
    bits = ["a", "The", " the", "'s", "'LL", " ", "  ", "\n", "\t", " ", "　", "é", "ß", "中文", "🙂", "👩‍👩‍👧", "0", "123456", "<|endoftext|>", "\x00", "\x7f", "....", "-_-", "aaaaaaa", "Ω", "﻿"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))) for i in range(1500)]
    rows += [(None, "no id"), (5000, None), (5001, ""), (5002, "again"), (5002, "again"), (5003, "ab" * 5_000), (5004, " " * 5_000), (5005, "🙂" * 3_000), (5006, "word " * 60_000)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, ids string, n_tokens int, piece string")
    result = round_trip_digests(df, PATH, public_tokenizers.PATTERN)
    assert got(result) == sorted(((d, *digests(reference, t)) for d, t in rows), key=str)
    assert got(round_trip_digests(df.limit(0), PATH, public_tokenizers.PATTERN)) == []
