"""Toxicity: held-out accuracy, the kernel against its definition, and the named cases."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity as X


def plain_kernel(a, b):
    def shape(w):
        out = {}
        for i in itertools.combinations(range(len(w)), 3):
            if i[2] - i[0] < X.SPAN:
                out[tuple(w[k] for k in i)] = out.get(tuple(w[k] for k in i), 0) + X.DECAY ** (i[2] - i[0] - 2)
        return out

    p, q = shape(a), shape(b)
    dot = lambda u, v: sum(x * v.get(k, 0) for k, x in u.items())
    n = (dot(p, p) * dot(q, q)) ** 0.5
    return dot(p, q) / n if n else 0.0


def test_kernel_and_bound():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 14))) for _ in range(300)]
    marks = [w for w in words if len(w) > 5][:6]
    text = X.Text([" ".join(words)])
    spelled = [text.spell(i) for i in range(len(text.first))]
    assert spelled == [bytes(ord(c) - 96 for c in w) for w in words]
    f = X.Featurizer([bytes(ord(c) - 96 for c in w) for w in marks])
    want = np.array([[plain_kernel(w, m) for m in marks] for w in words])
    want[want < X.FLOOR] = 0
    want **= X.POWER
    got = f.values(text, np.arange(len(words)))
    close = np.abs(np.array([[plain_kernel(w, m) for m in marks] for w in words]) - X.FLOOR) < 1e-5
    assert np.allclose(got[~close], want[~close], atol=1e-5)
    assert set(np.flatnonzero((want * ~close).any(axis=1))) <= set(f.suspects(text).tolist())


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(docs, labels)
    rows = X.score_texts(docs, model, keep=["doc_id"]).join(labels, "doc_id").withColumn("held", X.held_out())
    return model, rows.filter("held").select("score", "predicted", "toxic").toPandas()


def test_held_out_accuracy(scored):
    rows = scored[1]
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    # about 300 toxic documents to learn from; with 1,000 the recall is above 0.99 (README)
    assert len(bad) > 50 and bad.predicted.mean() > 0.5 and good.predicted.mean() < 0.01
    assert (np.mean(bad.score.values[:, None] > good.score.values[None, :])) > 0.9


def test_gaps_and_insertions(scored):
    model = scored[0]
    plain, gapped, cut, dotted, clean, none = model.score(["an idiot here", "an i d i o t here", "an id-iot here", "i.d.i.o.t", "an island here", ""])
    assert min(plain, gapped, cut, dotted) > 0.7 and clean < 0.3 and none < 0.3
    assert model.score(["worthxless"])[0] > 5 * model.score(["a word less"])[0]


def test_edge_rows(spark, scored):
    rows = [(1, None, 5), (2, "", 5), (None, "what a stupid loser", 5), (3, "x" * 2_000_000, 5), (4, "a b " * 200_000, 5), (4, "퟿ 🙂\n\n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = X.score_texts(df, scored[0], keep=["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1]
    assert X.score_texts(df.limit(0), scored[0], keep=["doc_id"]).count() == 0


def test_no_usable_labels(spark):
    docs = spark.createDataFrame([(1, "fine words"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert X.train(docs, labels) is None
    assert [r["score"] for r in X.score_texts(docs, None, keep=["doc_id"]).collect()] == [0.0, 0.0]


def test_training_never_reads_held_out_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = labels.filter(~X.held_out())
    assert kept.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).count() == 0 and 0 < kept.count() < labels.count()


def test_memory_of_training():
    """Features of many sentences are worked out in small blocks: the driver trains."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    marks = [word() for _ in range(96)]
    texts = [" ".join(word()[:5] + rng.choice(marks)[:6] for _ in range(300)) for _ in range(60)]
    featurizer = X.Featurizer([bytes(ord(c) - 96 for c in w) for w in marks])
    tracemalloc.start()
    owner, rows = featurizer.all_sentences(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(owner.tolist())) == 60 and peak < 150e6, peak
