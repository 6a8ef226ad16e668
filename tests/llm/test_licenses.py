"""License scans against exact containment over every window."""

import re

import pytest

from quire.llm.licenses import N, TEMPLATES, bands_for, scan


def shingles(words):
    return {tuple(words[i : i + N]) for i in range(len(words) - N + 1)}


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(text):
    w, out = words(text), set()
    for name, notice in TEMPLATES.items():
        t = words(notice)
        want, m = shingles(t), len(t)
        if any(len(want & shingles(w[k : k + 2 * m])) >= 0.75 * len(want) for k in range(0, max(1, len(w)), m)):
            out.add(name)
    return out


def got(df):
    return [(r["doc_id"], {m["license"] for m in r["matches"]}) for r in scan(df).collect()]


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    assert any(want.values())
    assert dict(got(docs)) == want


def test_planted_notices(spark):
    filler = " ".join(f"word{i}" for i in range(500))
    cut = TEMPLATES["MIT-grant"].replace("hereby ", "").replace("sublicense", "license")
    rows = [(i, f"{filler[: 13 * i]} {n} {filler}") for i, n in enumerate(TEMPLATES.values())]
    rows += [(50, filler + cut + filler), (51, "licensed under the terms of nothing at all " + filler)]
    found = dict(got(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == {i: plain(t) for i, t in rows}
    assert all(n in found[i] for i, n in enumerate(TEMPLATES)) and found[50] == {"MIT-grant"} and not found[51]


@pytest.mark.parametrize("m", [5, 7, 20, 60])
def test_band_guarantee(m):
    j = 0.75 * (m - 4) / (2 * m - 4 + 0.25 * (m - 4))
    assert 1 - (1 - j) ** bands_for(m) >= 0.999


def test_edge_rows(spark):
    notice = TEMPLATES["Apache-2.0"]
    rows = [(1, None), (2, ""), (None, notice), (4, notice), (4, notice), (5, "one two"), (6, "a b c " * 100_000 + notice)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, words int, matches string")
    assert sorted(map(str, got(df))) == sorted(str((i, plain(t))) for i, t in rows)
    assert scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scan(df, {"short": "too short"})
