"""Translation work: cases, invariants and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import translate as TR


def brute_chunks(text, sep, limit):
    if len(text) <= limit:
        return [text]
    out, cur = [], ""

    def flush():
        nonlocal cur
        if cur.strip(" \t\r\n"):
            out.append(cur.strip(" \t\r\n"))
        cur = ""

    for p in text.split(sep):
        if len(p) > limit:
            flush()
            out.extend(p[i:i + limit] for i in range(0, len(p), limit))
        elif not cur:
            cur = p
        elif len(cur) + len(p) + len(sep) <= limit:
            cur += sep + p
        else:
            flush()
            cur = p
    flush()
    return out


def chunks_of(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: [] for i in range(len(texts))}
    for r in TR.chunk_text(df, **kw).orderBy("doc_id", "chunk_no").collect():
        got[r.doc_id].append(r.text)
    return [got[i] for i in range(len(texts))]


def test_long_paragraphs_are_cut(spark):
    text = "甲" * 23 + "\n\n" + "乙" * 9
    assert chunks_of(spark, [text], max_chars=10) == [["甲" * 10, "甲" * 10, "甲" * 3, "乙" * 9]]


def test_chunks_match_brute_force_and_keep_all_text(spark):
    rng = random.Random(2)
    texts = ["\n".join("".join(rng.choice("ab ") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    got = chunks_of(spark, texts, sep="\n", max_chars=20)
    for text, chunks in zip(texts, got):
        assert chunks == brute_chunks(text, "\n", 20)
        assert all(len(c) <= 20 for c in chunks)
        assert "".join("".join(chunks).split()) == "".join(text.split())


STOPS = "。！？；，;!?"


def brute_align(parts):
    parts = list(parts)
    for i in range(len(parts) - 1):
        a, b = parts[i], parts[i + 1]
        if not a or b is None or a[-1] in STOPS + ".":
            continue
        limit = min(32, min(len(a), len(b)) // 4)
        if limit <= 0:
            continue
        ahead = next((k + 1 for k, c in enumerate(b[:limit]) if c in STOPS), None)
        behind = next((k for k, c in enumerate(reversed(a[-limit:])) if c in STOPS), None)
        if ahead and ahead < len(b) and (behind is None or ahead <= behind):
            parts[i], parts[i + 1] = a + b[:ahead], b[ahead:]
        elif behind and behind < len(a):
            parts[i], parts[i + 1] = a[:-behind], a[-behind:] + b
    return parts


@pytest.mark.parametrize("seed", range(3))
def test_alignment_matches_brute_force_and_keeps_the_text(spark, seed):
    rng = random.Random(seed)
    groups = [
        ["".join(rng.choice("字词句" * 6 + "，。;") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 5))]
        for _ in range(40)
    ]
    rows = [(g, n, t) for g, parts in enumerate(groups) for n, t in enumerate(parts, 1)]
    df = spark.createDataFrame(rows, "g long, member_no long, translation string")
    got = {}
    for r in TR.align_boundaries(df, ["g"], "zh").orderBy("g", "member_no").collect():
        got.setdefault(r.g, []).append(r.translation)
    for g, parts in enumerate(groups):
        assert got[g] == brute_align(parts)
        assert "".join(got[g]) == "".join(parts)
    assert TR.align_boundaries(df, ["g"], "en") is df


def test_replies_in_every_shape(spark):
    items = '{"items":[{"id":"a","text":"x"},{"id":"b","text":"y"}]}'
    rows = [
        (1, 2, items), (2, 2, f"```json\n{items}\n```"), (3, 2, f"Here you go: {items} bye"), (4, 2, "nothing"), (5, 2, '{"k":1}'),
        (6, 1, '{"id":"a","text":"x"}'), (7, 2, '{"id":"a","text":"x"}'), (8, 2, items + "}"), (9, 2, "[1,2]"),
    ]
    df = spark.createDataFrame(rows, "n long, n_regions long, content string")
    got = {}
    for r in TR.decode_replies(df).collect():
        got.setdefault(r.n, []).append(r.error or r.id + r.text)
    both = ["ax", "by"]
    assert got == {1: both, 2: both, 3: both, 4: ["unparsable"], 5: ["no_items"], 6: ["ax"], 7: ["no_items"], 8: ["unparsable"], 9: ["unparsable"]}


def test_retry_after(spark):
    now = "2024-01-01 00:00:00"
    rows = [("5",), (" 7.5 ",), ("-3",), ("Mon, 01 Jan 2024 00:00:20 GMT",), ("Sun, 31 Dec 2023 00:00:00 GMT",), ("soon",), (None,)]
    df = spark.createDataFrame(rows, "h string")
    got = [r.s for r in df.select(TR.retry_after_seconds(F.col("h"), F.lit(now).cast("timestamp")).alias("s")).collect()]
    assert got == [5.0, 7.5, 0.0, 20.0, 0.0, None, None]


def test_attempts_of_one_busy_request_are_numbered(spark):
    a = spark.range(4000).select(
        F.lit(1).alias("request_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7).alias("ts")
    )
    got = TR.number_attempts(a).orderBy("event_id").collect()
    assert [r.attempt_no for r in got] == list(range(1, 4001))


def test_partial_groups_are_dropped(spark):
    regions = spark.createDataFrame([(1, "a", "g"), (1, "b", "g"), (1, "c", "h")], "doc_id long, region_id string, group_id string")
    saved = spark.createDataFrame([(1, "a", "A"), (1, "c", "C")], "doc_id long, region_id string, translation string")
    got = {r.region_id: r.translation for r in TR.atomic_groups(regions, saved).collect()}
    assert got == {"a": None, "b": None, "c": "C"}


def test_language_codes(spark):
    df = spark.createDataFrame([("chi_sim+eng",), ("zh,en",), ("",), ("fra, ZH-TW",)], "s string")
    got = [r.o for r in df.select(TR.ocr_languages(F.col("s")).alias("o")).collect()]
    assert got == [["zh-Hans", "en-US"], ["zh-Hans", "en-US"], ["zh-Hans", "en-US"], ["fra", "zh-Hant"]]


def test_even_sample_takes_first_and_last(spark):
    regions = spark.range(1000).select(
        F.lit(1).alias("doc_id"), (F.col("id") / 10).cast("long").alias("page_index"), F.col("id").alias("line"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )
    r = TR.even_sample(regions).first()
    parts = r.sample.split("\n\n")
    assert r.n_sampled == 80 and parts[0] == "[Page 1] t0" and parts[-1] == "[Page 100] t999"
    assert parts == [f"[Page {p // 10 + 1}] t{p}" for p in (i * 999 // 79 for i in range(80))]


def test_network_failures_are_attempts(spark):
    rows = [(1, None, 1), (2, None, 3), (3, 200, 1), (4, 404, 1), (5, 503, 1)]
    a = spark.createDataFrame([(*r, 0, None) for r in rows], "id int, status_code int, attempt_no int, body_bytes int, retry_after string").withColumn("ts", F.timestamp_seconds("id"))
    for profile in ("web", "native"):
        got = {r.id: r.verdict for r in TR.classify_reply(a, profile).collect()}
        assert got == {1: "retry", 2: "fail", 3: "ok", 4: "fail", 5: "retry"}
        assert {r.id for r in TR.retry_schedule(a, profile).filter("delay IS NOT NULL").collect()} == {1, 5}
