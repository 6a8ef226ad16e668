"""Resampling against a plain version in Python, and the selection against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import oracle
import pyarrow as pa
import pytest

from quire.llm.queries import ORACLES, QUERIES
from quire.llm.resample import _BETWEEN, cutoff, feature_codes, resample
from quire.llm.words import Batch


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if x]
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target, percent, least, buckets=10_000, seed=7):
    """Rows of ``resample`` as sorted tuples."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, aim = Counter(), Counter()
    for _, t in docs:
        raw.update(map(bucket, features(t)[1]))
    for _, t in target:
        aim.update(map(bucket, features(t)[1]))
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
    rows = []
    for d, t in docs:
        w, f = features(t)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(order[: len(order) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(rows):
    return sorted((tuple(r) for r in rows.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_importance_resampling"])
def test_matches_sql(spark, sf_dir, name):
    assert oracle.compare(spark, oracle.connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name]) is None


def test_odd_texts(spark):
    rng = random.Random(3)
    bits = ["Ab", "é", "É", " ", "_", "-", "9", "🙂", "\x7f", "\x00", "`", "{", "ß", "\n", "x" * 70, "q" * 64, "Z"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(None, "a b c d"), (301, None), (302, ""), (303, "w " * 30_000), (304, "y" * 200_000)]
    target = [(1, "ab é 9 zz ab"), (2, None), (3, "x" * 70)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, rank int")
    goal = spark.createDataFrame(target, "item_id long, text string")
    assert got(resample(df, goal, percent=40, least_words=3)) == plain(docs, target, 40, 3)
    assert got(resample(df, goal.limit(0), percent=40, least_words=3)) == plain(docs, [], 40, 3)
    assert got(resample(df.limit(0), goal)) == []
    assert {r[4] for r in got(resample(df, goal, percent=0))} == {None}
    assert got(resample(df, goal, percent=100, least_words=0)) == plain(docs, target, 100, 0)


def test_repeated_rows_take_one_place_each(spark):
    docs = [(7, "one two three")] * 50 + [(8, "four five six")] * 50
    rows = got(resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([], "text string"), 30, 1))
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, 31))
    assert rows == plain(docs, [], 30, 1)


def test_codes():
    words = ["a", "", "bc", "x" * 64, "x" * 65, "é🙂", "y" * 300, "z"]
    batch = Batch(pa.array([" ".join(words), "", "b"]), hashed=False, between=_BETWEEN)
    one, two = feature_codes(batch)
    w = [x for x in words if x]
    assert [int(x) for x in one] == [zlib.crc32(x.encode()) for x in [*w, "b"]]
    assert [int(x) for x in two[: len(w) - 1]] == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(w, w[1:])]


def test_cutoff_is_exact(spark):
    """Ties in every part of the key, partitions of unlike sizes, first, last and middle places."""
    rng = random.Random(9)
    rows = [(rng.choice([5, 5, 5, -3, rng.randrange(100)]), int(rng.random() < 0.1), rng.randrange(20), i) for i in range(3000)]
    rows.sort(key=lambda r: r[0] == 5)
    keys = spark.createDataFrame(rows, "score long, no_id long, id long, row long").coalesce(3).union(
        spark.createDataFrame([(1, 0, 0, 9999)], "score long, no_id long, id long, row long")
    )
    order = sorted([*rows, (1, 0, 0, 9999)], key=lambda r: (-r[0], *r[1:]))
    for k in (1, 2, 1500, 3000, 3001):
        assert cutoff(keys, k) == order[k - 1]
