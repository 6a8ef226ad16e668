"""Page operators on the small documents the semantics were written for."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import page_spec as S
from quire.operators import pages as P


def brute_select(spec, n):
    if n < 1 or not spec.strip():
        return list(range(1, n + 1))
    got = set()
    for part in (p.strip() for p in spec.split(",")):
        if not part:
            continue
        if "-" in part:
            a, b = part.split("-", 1)
            a, b = (int(a) if a else 1), (int(b) if b else n)
            got |= set(range(max(1, min(a, b)), min(n, max(a, b)) + 1))
        elif 1 <= int(part) <= n:
            got.add(int(part))
    return sorted(got)


def brute_order(spec, n):
    got = []
    for part in (p.strip() for p in spec.split(",")):
        if not part:
            continue
        if "-" in part:
            a, b = part.split("-", 1)
            a, b = (int(a) if a else 1), (int(b) if b else n)
            got += range(a, b + 1) if a <= b else range(a, b - 1, -1)
        else:
            got.append(int(part))
    return [p for p in got if 1 <= p <= n]


def random_spec(rng):
    parts = []
    for _ in range(rng.randint(0, 5)):
        a, b = rng.randint(1, 14), rng.randint(1, 14)
        parts.append(rng.choice([f"{a}", f"{a}-{b}", f"{a}-", f"-{b}", " ", f" {a} - {b} "]))
    return ",".join(parts)


def marker_pages(spark):
    docs = spark.createDataFrame([(1, "alpha marker\nbeta marker\ngamma marker")], "doc_id long, text string")
    return P.explode_pages(docs)


def test_known_specs(spark):
    df = spark.createDataFrame([(10,)], "n long")
    every = F.sequence(F.lit(1).cast("bigint"), F.col("n"))
    sel = S.selection("1,3-4,-2,9-", F.col("n"))
    row = df.select(F.filter(every, sel.contains).alias("p")).first()
    assert row.p == [1, 2, 3, 4, 9, 10]
    assert df.select(F.filter(every, S.selection("", F.col("n")).contains).alias("p")).first().p == list(range(1, 11))


@pytest.mark.parametrize("seed", range(4))
def test_selection_and_order_match_brute_force(spark, seed):
    rng = random.Random(seed)
    specs = [random_spec(rng) for _ in range(12)]
    rows = [(i, s, n) for i, s in enumerate(specs) for n in (1, 2, 5, 9, 12)]
    df = spark.createDataFrame(rows, "i int, spec string, n long")
    every = F.sequence(F.lit(1).cast("bigint"), F.col("n"))
    per_row, order = S.selection(F.col("spec"), F.col("n")), S.ordering(F.col("spec"), F.col("n"))

    def columns(sel, by):
        return [
            F.filter(every, sel.contains).alias("sel"),
            F.transform(every, sel.rank).alias("rank"),
            sel.total().alias("total"),
            F.transform(every, by.positions).alias("pos"),
            by.total().alias("len"),
        ]

    def check(r, spec, n):
        want = brute_select(spec, n)
        assert r.sel == want, (spec, n)
        assert r.rank == [sum(w <= p for w in want) for p in range(1, n + 1)], (spec, n)
        assert r.total == len(want)
        placed = {pos: page for page, at in enumerate(r.pos, 1) for pos in at}
        assert [placed[k] for k in sorted(placed)] == brute_order(spec, n), (spec, n)
        assert r.len == len(brute_order(spec, n))

    for r in df.select("spec", "n", *columns(per_row, order)).collect():
        check(r, r.spec, r.n)
    for spec in specs:
        sel, by = S.selection(spec, F.col("n")), S.ordering(spec, F.col("n"))
        for r in df.filter(F.col("spec") == spec).select("n", *columns(sel, by)).collect():
            check(r, spec, r.n)


def test_strict_spec(spark):
    df = spark.createDataFrame([("1, 3-5", 5), ("6", 5), ("", 4), ("3-1", 5), ("1,,2", 5), ("a", 5)], "spec string, n_pages long")
    got = {r.spec: (r.error, r.indexes) for r in P.page_indexes(df, F.col("spec")).collect()}
    assert got["1, 3-5"] == (None, [0, 2, 3, 4])
    assert got["6"] == ("out_of_range", None)
    assert got[""] == (None, [])
    assert got["3-1"][0] == got["1,,2"][0] == got["a"][0] == "syntax"


def test_reorder_then_delete(spark):
    pages = P.edit_pages(marker_pages(spark), {"reorder_pages": "3,1,2", "delete_pages": "2"}, "web")
    assert [(r.page_no, r.n_pages, r.text) for r in pages.orderBy("page_no").collect()] == [
        (1, 2, "gamma marker"),
        (2, 2, "beta marker"),
    ]


def test_edit_order_differs_by_profile(spark):
    opts = {"delete_pages": "1", "reorder_pages": "2,1"}
    web = P.edit_pages(marker_pages(spark), opts, "web").orderBy("page_no").collect()
    native = P.edit_pages(marker_pages(spark), opts, "native").orderBy("page_no").collect()
    assert [r.text for r in web] == ["alpha marker"]
    assert [r.text for r in native] == ["gamma marker", "beta marker"]


def test_rotation_profiles(spark):
    pages = marker_pages(spark).withColumn("rotation", F.lit(270))
    assert {r.rotation for r in P.rotate_pages(pages, "all", 180, "web").collect()} == {180}
    assert {r.rotation for r in P.rotate_pages(pages, "all", 180, "native").collect()} == {90}
    assert {r.rotation for r in P.rotate_pages(pages, "", 180, "web").collect()} == {270}


def test_merge_spreads_one_huge_job(spark):
    order = spark.range(3000).select(
        F.lit(1).alias("job_id"), (F.col("id") + 1).alias("ord"), F.col("id").alias("doc_id"), (F.col("id") % 3 + 1).alias("n_pages")
    )
    pages = order.select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_pages")).alias("page_no")).withColumn("text", F.lit(""))
    merged = P.merge_documents(pages, order).orderBy("new_page_no").collect()
    assert [r.new_page_no for r in merged] == list(range(1, len(merged) + 1))
    assert [(r.doc_id, r.page_no) for r in merged] == sorted((r.doc_id, r.page_no) for r in merged)


def test_search_folds_case_and_accents(spark):
    docs = spark.createDataFrame([(1, "Été ete ÉTÉ\nnothing\neteete (a.b)")], "doc_id long, text string")
    pages = P.explode_pages(docs)
    assert [(r.page_no, r.char_pos) for r in P.search(pages, " étE ").orderBy("match_no").collect()] == [
        (1, 1), (1, 5), (1, 9), (3, 1), (3, 4),
    ]
    assert P.search(pages, "(a.b)").count() == 1
    assert [r.shown for r in P.search(pages, "ete", shown=2).orderBy("match_no").collect()][:3] == [True, True, False]
    near = P.match_neighbours(P.search(pages, "ete")).orderBy("match_no").collect()
    assert (near[0].prev_no, near[-1].next_no) == (5, 1)
    with pytest.raises(ValueError):
        P.search(pages, "x" * 257)


def test_search_finds_decomposed_letters_in_place(spark):
    """Marks that stand alone, in the text or in the query, and letters of other scripts."""
    cases = [
        ("cafe\u0301 CAFÉ caf\u00e9 \u0301cafe", "café", [1, 7, 12, 18]), ("Istanbul İstanbul istanbul", "istanbul", [1, 10, 19]),
        ("i\u0307x İx", "IX", [1, 5]), ("Ά ά α \u03b1\u0301", "α", [1, 3, 5, 7]), ("Йод йод и\u0306од", "иод", [1, 5, 9]),
        ("e\u0301\u0301e\u0323\u0302te", "eete", [1]), ("tie\u0302\u0301ng Vie\u0323\u0302t", "việt", [9]), ("a.b a\u0301.b", "a.b", [1, 5]),
    ]
    for text, query, places in cases:
        pages = P.explode_pages(spark.createDataFrame([(1, text)], "doc_id long, text string"))
        assert [r.char_pos for r in P.search(pages, query).orderBy("match_no").collect()] == places, (text, query)
    with pytest.raises(ValueError):
        P.search(pages, "\u0301")


def test_ocr_text_keeps_source_page_numbers(spark):
    docs = spark.createDataFrame([(1, "one\n \nthree"), (2, " ")], "doc_id long, text string")
    got = {r.doc_id: r.ocr_text for r in P.assemble_ocr_text(P.explode_pages(docs), "web").collect()}
    assert got == {1: "## Page 1\n\none\n\n## Page 3\n\nthree\n", 2: "\n"}


def test_selection_and_edits_do_not_shuffle(spark, sf_dir):
    from quire.plans import QUERIES

    for name in ("p3_select_pages", "p5_reorder_pages", "p7_delete_pages", "p13_edit_pages_web", "p14_preview_pages", "p19_interleave_bilingual"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        if name != "p19_interleave_bilingual":
            assert "Exchange" not in plan and "Window" not in plan, name
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_broken_spec_is_reported(spark):
    df = spark.createDataFrame([("1,3-4,-2,9-",), ("",), (" 2 - 3 ,",), ("a",), ("1-2-3",), ("1.5",)], "s string")
    got = [r.e for r in df.select(S.lenient_error(F.col("s")).alias("e")).collect()]
    assert got == [False, False, False, True, True, True]
    with pytest.raises(ValueError):
        S.selection("a", F.col("n"))
