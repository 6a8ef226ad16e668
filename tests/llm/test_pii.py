"""Personal data against plain regular expressions, and bootstrapped identifiers."""

import hashlib
import random
import re

from quire.llm.pii import KINDS, find, mask_text, written
from quire.llm.queries import QUERIES

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in PLAIN[kind].finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def got(df, **options):
    return {(r["doc_id"], r["b"], r["s"]) for r in find(df, **options).select("doc_id", written("base").alias("b"), written("spans").alias("s")).collect()}


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {(r["doc_id"], base(r["text"])) for r in docs.collect()}
    assert any(b for _, b in want)
    assert {(d, b) for d, b, _ in got(docs)} == want


def test_registered_columns(spark, sf_dir):
    """Every column of the query: counts and digest follow from the plain expressions."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op10_bootstrapped_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r["doc_id"]])
        kinds = [s.split(":")[0] for s in spans.split(",") if s]
        assert [r[f"n_{k}"] for k in KINDS] == [kinds.count(k) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(r["spans"].split(",")) | {""}


def test_odd_texts(spark):
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "x-y", ".", "_", "%", "1", "23", "456", "4111111111111111", " ", "-", "+", "(", ")", "\n", "255", "256", "é", "🙂", "5500 0000 0000 0004", "+49 (30) 1234-567", "1.2.3.4", "a@b.co"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))) for i in range(4000)]
    assert {(d, b) for d, b, _ in got(spark.createDataFrame(rows, "doc_id long, text string"))} == {(d, base(t)) for d, t in rows}


def test_patterns_discover_identifiers(spark):
    rows = [(i, f"user {i} says: mailto: u{i}@x{i}.org and then goes on") for i in range(8)]
    rows += [(100 + i, f"some other words mailto: k{i}(at)y{i}.org, yes item {i}") for i in range(3)]
    found = {d: s for d, b, s in got(spark.createDataFrame(rows, "doc_id long, text string"))}
    for i in range(3):
        a = rows[8 + i][1].index("k")
        assert found[100 + i] == f"email:{a}:{a + len(f'k{i}(at)y{i}.org')}"
    assert all(found[i].count(":") == 2 for i in range(8))


def test_found_identifiers_make_new_patterns(spark):
    """Each word stands before identifiers of the word before it; only the first one has seeds."""
    words, texts = ["tel:", "fax:", "cell:", "desk:", "night:", "ward:"], [f"tel: +49 30 12345{i}{i}" for i in range(6)]
    for hop, word in enumerate(words):
        texts += [f"{word} 555-0{hop}0{i}" for i in range(3)]
        texts += [f"{word} 555-0{hop - 1}0{i}" for i in range(3) for _ in range(2) if hop]
    # a word that is mostly followed by other tokens, and one with two known identifiers
    texts += ["room 555-0000", "room 555-0001", "room 555-0002", *[f"room 77-{i}00" for i in range(3)], "bay 555-0000", "bay 555-0001", "bay 88-100"]
    rows = list(enumerate(texts))
    found = {d: s for d, b, s in got(spark.createDataFrame(rows, "doc_id long, text string"))}
    for i, text in rows:
        at = text.index(" ") + 1
        assert found[i] == ("" if " 77-" in text or " 88-" in text else f"phone:{at}:{len(text)}"), text


def test_mask(spark):
    df = spark.createDataFrame([(1, "é a@b.co and 1.2.3.4!"), (2, "none"), (3, None)], "doc_id long, text string")
    spans = find(df).withColumnRenamed("doc_id", "id")
    rows = df.join(spans, df.doc_id == spans.id).select("doc_id", mask_text(df.text, spans.spans).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in rows} == {1: "é [EMAIL] and [IP]!", 2: "none", 3: None}


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (4, "1.2.3.4"), (4, "1.2.3.4"), (5, "9" * 6_000), (6, "1 " * 50_000), (7, "a" * 6_000 + "@b.co"), (8, "+1" + "-" * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, seeds int")
    result = find(df).select("doc_id", written("base").alias("b")).collect()
    assert sorted((str(r["doc_id"]), r["b"]) for r in result) == sorted((str(d), base(t)) for d, t in rows)
    assert find(df.limit(0)).count() == 0
