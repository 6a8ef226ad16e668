"""The n-gram join against all pairs."""

import random
import re
from collections import defaultdict

import pytest

from quire.llm.ngram_join import components, link_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    for i, s in enumerate(sets):
        for j in set().union(*(holders[x] for x in s)) if s else ():
            if j < i and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                root[find(i)] = find(j)
    name = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        name[find(i)].append(d)
    big = 10**9
    return sorted(((d, len(sets[i]), min(name[find(i)], key=lambda x: big if x is None else x)) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(d != c for d, _, c in want)
    assert got(link_documents(docs)) == want


@pytest.mark.parametrize("seed", range(2))
def test_chains_and_sizes(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    common = [word() for _ in range(45)]
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 5, 6, 8, 9, 11, 13, 16, 30, 80, 200]))]
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 14)):
                k = rng.randrange(len(text))
                text[k : k + 1] = rng.choice([[], [word()], [word(), word()]])
            base = text if rng.random() < 0.5 else base
            if rng.random() < 0.3:
                text = text + common
            rows.append((len(rows), rng.choice([" ", "\n"]).join(text).title()))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(link_documents(df, rows=16)) == plain(rows)


def test_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "A  B"), (4, "a b"), (5, long), (6, long + " more"), (7, "é x É y z q"), (8, "a a a a a a a a")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, slice string, row int")
    assert got(link_documents(df)) == plain(rows)
    assert link_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [7, 1_000_000])
def test_components(spark, share):
    """Chains and stars; few edges take no round, many take rounds over the trees of the tasks."""
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(90, 100)] + [(200, 205), (205, 203), (300, 100)]
    random.Random(6).shuffle(edges)
    spark.sparkContext.setJobGroup(f"components-{share}", "")
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5), share=share).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{share}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {i: 0 for i in range(41)} | {i: 90 for i in [*range(90, 101), 300]} | {200: 200, 203: 200, 205: 200}
    assert {r["node"]: r["label"] for r in got} == want
    assert share == 7 or jobs <= 5


def test_near_copies_below_the_limit_meet_once(spark):
    """A family whose members share most lists but do not link: no pair may meet in each of them."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = list(base)
        for k in rng.sample(range(300), 16):
            text[k] = f"x{i}_{k}" if rng.random() < 0.3 else f"y{k}_{rng.randrange(4)}"
        rows.append((i, " ".join(text)))
    assert got(link_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
