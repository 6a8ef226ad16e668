"""The pipeline stage by stage against plain versions of each stage."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

import corpus_pipeline  # noqa: E402
from test_ngram_join import plain as components  # noqa: E402
from test_packing import plain_pieces  # noqa: E402
from test_pii import PLAIN, base  # noqa: E402,F401


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Documents before the first stage and the result of each."""
    from quire.llm.common import stored

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
        out[name] = docs
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "pii", "packing"]
    for name in ("toxicity", "exact_dedup", "ngram_join", "pii"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_toxic_go_clean_stay(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic IS NOT NULL").collect()
    before, after = rows(stages["documents"]), rows(stages["toxicity"])
    assert all(after[i] == before[i] for i in after)
    clean = [r["doc_id"] for r in labels if r["toxic"] == 0]
    assert sum(i in after for i in clean) >= 0.97 * len(clean)


def test_exact_stage(stages):
    before, after = rows(stages["toxicity"]), rows(stages["exact_dedup"])
    best = {}
    for r in before.values():
        key = "".join((r["text"] or "").translate(dict.fromkeys(map(ord, " \t\n\r\x0b\x0c"))))
        best.setdefault(key, []).append((-len(r["text"] or ""), r["doc_id"]))
    assert set(after) == {min(g)[1] for g in best.values()}
    assert all(after[i] == before[i] for i in after)


def test_near_stage(stages):
    before, after = rows(stages["exact_dedup"]), rows(stages["ngram_join"])
    named = components([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {c for _, _, c in named}
    assert all(after[i] == before[i] for i in after)


def test_pii_stage(stages):
    before, after = rows(stages["ngram_join"]), rows(stages["pii"])
    assert set(after) == set(before)
    for i, r in after.items():
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        if not base(before[i]["text"]):
            assert r == before[i]


def test_packing_stage(stages):
    got = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages["packing"].collect()}
    assert got == plain_pieces([(i, r["text"]) for i, r in rows(stages["pii"]).items()])


def test_edge_rows(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    few = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a@b.co " * 60, "en", "s", 420), (2, "a@b.co " * 60, "en", "s", 420), (3, "clean words here", None, "s", None)]
    docs = spark.createDataFrame(few, empty.schema)
    for table, left in ((empty, 0), (docs, 3)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, sf_dir)
            assert table.columns == empty.columns, name
        assert table.count() == left
        assert (corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() > 0) == (left > 0)
