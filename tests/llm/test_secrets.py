"""Secrets against the plain patterns, and formats learnt from labelled values."""

import hashlib
import random
import re
import string

from quire.llm.queries import QUERIES
from quire.llm.secrets import END, KINDS, _fold, base_matches, find, infer, likelihood, tables, written

PLAIN = [
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
]


def base(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(text or ""):
            if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def got(df, **options):
    return [(r["doc_id"], r["b"], r["s"]) for r in find(df, **options).select("doc_id", written("base").alias("b"), written("spans").alias("s")).collect()]


def test_odd_texts():
    rng = random.Random(2)
    bits = ["token", "Secret", "PASSWD", "api_key", "apiKey", "=", ":", " ", "'", '"', "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "x", "\n", "é", "ſecret", "password", "-_."]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base_matches(text)) == base(text), text


def test_registered_columns(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_secret_scan"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r["doc_id"]])
        kinds = [s.split(":")[0] for s in spans.split(",") if s]
        assert [r[f"n_{k}"] for k in KINDS] == [kinds.count(k) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(r["spans"].split(",")) | {""}


def _prose(rng):
    return " ".join("".join(rng.choice("eeetaoinshrdlu") for _ in range(rng.randrange(2, 11))) for _ in range(40))


def test_formats_find_unlabelled_secrets(spark):
    """Values of the labelled formats without their key words are found, other runs are not."""
    rng = random.Random(4)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda: "-".join("".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(5)) for _ in range(4))
    rows = [(i, f"{_prose(rng)} password={hexa(18)} {_prose(rng)}") for i in range(150)]
    rows += [(200 + i, f"{_prose(rng)} api_key: {key()} {_prose(rng)}") for i in range(150)]
    bare = {400 + i: hexa(17) + "7" if i % 2 else "Q2" + key()[2:] for i in range(40)}
    bare = {i: v for i, v in bare.items() if re.search("[a-zA-Z]", v)}
    plain = ["release-2.4.11-beta", "mail8.example.com", "figure_12_of_the_book", "internationalization2", "2024-01-01T10:00:00Z", "thehouse12ontheleft"]
    rows += [(i, f"{_prose(rng)} ({v}) {_prose(rng)}") for i, v in bare.items()]
    rows += [(500 + i, f"{_prose(rng)} {v} {_prose(rng)}") for i, v in enumerate(plain * 3)]
    texts = dict(rows)
    result = {d: (b, s) for d, b, s in got(spark.createDataFrame(rows, "doc_id long, text string"))}
    hits = 0
    for i, v in bare.items():
        a = texts[i].index(v)
        assert result[i] in (("", ""), ("", f"assign:{a}:{a + len(v)}"))
        hits += result[i][1] != ""
    assert hits >= 0.85 * len(bare)
    assert {plain[(d - 500) % len(plain)] for d in texts if d >= 500 and result[d] != ("", "")} == set()
    assert all(result[d][0] == result[d][1] for d in texts if d < 400)


def test_merging_keeps_lengths_and_opens_loops():
    """Values of one length keep a chain of states; values of any length share a state."""
    rng = random.Random(1)

    def counts(values):
        out = {}
        for v in values:
            for i in range(len(v) + 1):
                node = out.setdefault("x" * i, {})
                ch = v[i] if i < len(v) else END
                node[ch] = node.get(ch, 0) + 1
        return out

    fixed = infer(counts(["".join(rng.choice("01") for _ in range(8)) for _ in range(300)]))
    assert len(fixed) == 9
    free = infer(counts(["".join(rng.choice("01") for _ in range(1 + int(rng.expovariate(0.1)))) for _ in range(2000)]))
    assert len(free) <= 3 and any(s in free for s in free[-1].next.values())
    fits = tables(fixed)
    assert likelihood(fits, "01010101") > likelihood(fits, "0101010") + 0.3 and likelihood(fits, "01010101") > likelihood(fits, "0101z101") + 0.3
    assert _fold(fixed[0], fixed[0]) is None


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "token=abcdef"), (4, "AKIA" + "A" * 16), (4, "AKIA" + "A" * 16), (5, "9a" * 300_000), (6, "token:" * 50_000), (7, "password = 'é'"), (8, "a1" * 6 + ".")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, base int")
    assert sorted(((d, b) for d, b, _ in got(df)), key=str) == sorted(((d, base(t)) for d, t in rows), key=str)
    assert got(df.limit(0)) == []
