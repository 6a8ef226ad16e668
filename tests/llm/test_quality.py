"""Quality rules against a plain version, and the cases the docstring names."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm.quality import judge_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: base_counts(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in judge_documents(docs).collect()}
    assert got == want


@pytest.mark.parametrize("kept", [True, False])
def test_labelled_quality(spark, sf_dir, kept):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id")
    rows = judged.filter((F.col("quality") == int(kept)) & ~F.col("base_failed")).select("kept").collect()
    assert sum(r["kept"] != kept for r in rows) <= 0.02 * len(rows)


def sentence(i):
    return f"The fox{i} of house{i} jumps{i} over{i} one{i} lazy{i} dog{i} while{i} nobody{i} watches{i}."


GOOD = "\n".join(map(sentence, range(8)))


def test_line_rules(spark):
    bad = "Home\nHOME NEWS SPORT BUY NOW\n" + GOOD + "\nAbout | News | Shop | Help\n" + sentence(3)
    rows = spark.createDataFrame([(1, bad), (2, GOOD)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in judge_documents(rows, with_text=True).collect()}
    assert got[2]["clean_text"] == GOOD and got[2]["kept"] and got[2]["n_failed_lines"] == 0
    assert got[1]["clean_text"] == GOOD and got[1]["n_dup_lines"] == 1 and got[1]["n_failed_lines"] == 4


def test_edge_rows(spark):
    long = "wörd x " * 300_000
    rows = [(None, GOOD, 1), (2, None, 1), (3, "", 1), (4, " \n\t", 1), (5, GOOD, 1), (5, GOOD, 1), (6, long, 1), (7, "a\x0bb \x1cc", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = judge_documents(df, with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        assert tuple(r[c] for c in NAMES) == base_counts(text)
    assert judge_documents(df.limit(0)).count() == 0
