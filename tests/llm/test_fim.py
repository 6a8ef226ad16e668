"""Fill-in-middle against slicing in Python, and exact round trips."""

import hashlib

from quire.llm.fim import BLOCK, fill_in_middle, restore
from quire.llm.queries import QUERIES


def plain(doc_id, text, seed=1):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "a", "é", "🙂", "🙂é\n\r \u0085x", "$1$2\\1\\$3", "line\nline\r\n", "<P", "<S", "P><<<S", "a<P>b", "<M>", "<<P", "x" * BLOCK, "🙂" * (BLOCK + 1),
    "ab🙂\n" * 3000, "\u0000nul", "é" * 50, "(?s)[a-z]{3}+", "z" * (3 * BLOCK),
]


def test_forms_and_round_trip(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40 * len(TEXTS))] + [(None, "no id"), (None, None), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, form string, n int, output string")
    out = fill_in_middle(df)
    got = out.withColumn("back", restore(out.output, out.form)).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(
        ((d, *plain(d, t)) for d, t in rows), key=key
    )
    assert all(r["back"] == r["text"] for r in got)
    assert fill_in_middle(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "0123🙂é\n89" * 600_000
    out = fill_in_middle(spark.createDataFrame([(2, text)], "doc_id long, text string"))
    row = out.withColumn("back", restore(out.output, out.form)).first()
    assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == plain(2, text) and row["form"] != "plain"
    assert row["back"] == text


def test_registered_columns(spark, sf_dir):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_fill_in_middle"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, a, m, output = plain(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, a, m)
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(output), sha(texts[r["doc_id"]] or ""))
    plan = QUERIES["op11_fill_in_middle"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
