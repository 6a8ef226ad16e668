"""Batch checks on small and on lopsided inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import validate as V


def brute_names(names):
    used, out, tried = set(), [], {}
    for name in names:
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        # a number that was taken once stays so
        k = tried.get(stem.lower(), 1)
        cand = f"{stem}-{k}" if k > 1 else stem
        while cand.lower() in used:
            k += 1
            cand = f"{stem}-{k}"
        tried[stem.lower()] = k
        used.add(cand.lower())
        out.append(cand + ext)
    return out


def name_rows(spark, jobs):
    rows = [(j, i, n) for j, names in jobs.items() for i, n in enumerate(names, 1)]
    return spark.createDataFrame(rows, "job_id long, ord long, name string")


def test_known_names(spark):
    got = V.unique_names(name_rows(spark, {1: ["same.txt", "same.txt"], 2: ["report.doc", "report.docx"]})).collect()
    assert sorted((r.job_id, r.ord, r.unique_name) for r in got) == [
        (1, 1, "same.txt"), (1, 2, "same-2.txt"), (2, 1, "report.doc"), (2, 2, "report-2.docx"),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "A", "a-2", "a-2-2", "b", "b-1", "c-7", "a-3", "d"]
    jobs = {j: [rng.choice(pool) + rng.choice([".pdf", ".md", ""]) for _ in range(rng.randint(1, 12))] for j in range(25)}
    got = {}
    for r in V.unique_names(name_rows(spark, jobs)).collect():
        got[(r.job_id, r.ord)] = r.unique_name
    for j, names in jobs.items():
        assert [got[(j, i)] for i in range(1, len(names) + 1)] == brute_names(names), (j, names)


def test_given_and_generated_names_of_a_large_family(spark):
    """100,000 files: copies of one stem among given numbered ones, in no order of theirs."""
    rng = random.Random(8)
    names = ["a.txt"] * 50_000 + [f"A-{k}.md" for k in range(2, 50_002)]
    rng.shuffle(names)
    names += ["a-2.x", "a-2-2", "a-02", "a-02"]
    rows = spark.createDataFrame(list(enumerate(names, 1)), "ord long, name string").withColumn("job_id", F.lit(1))
    got = [r.unique_name for r in V.unique_names(rows).orderBy("ord").collect()]
    assert got == brute_names(names)


def test_thousands_of_copies_are_numbered_in_order(spark):
    files = spark.range(5000).select(
        F.lit(1).alias("job_id"), (F.col("id") + 1).alias("ord"),
        F.when(F.col("id") % 3 == 0, F.lit("same.txt")).otherwise(F.concat(F.lit("scan-"), F.col("id").cast("string"), F.lit(".png"))).alias("name"),
    )
    got = V.unique_names(files).orderBy("ord").collect()
    assert [r.unique_name for r in got if r.name == "same.txt"][:3] == ["same.txt", "same-2.txt", "same-3.txt"]
    assert got[-2].unique_name == f"same-{(5000 + 2) // 3}.txt"
    assert all(r.unique_name == r.name for r in got if r.name != "same.txt")
    assert len({r.unique_name for r in got}) == 5000


def test_output_names(spark):
    rows = [("3-My.Report!.pdf", "pdf_edit", "edit"), ("..", "pdf_edit", "edit"), ("x" * 100 + ".pdf", "pdf_edit", "edit"), ("a.pdf", "pdf_edit", "merge")]
    df = spark.createDataFrame(rows, "first_name string, kind string, edit_action string")
    for c in ("ocr_output_format", "output_mode", "target"):
        df = df.withColumn(c, F.lit(""))
    got = [r.output_name for r in V.output_name(df.withColumn("n_inputs", F.lit(1))).collect()]
    assert got == ["My-Report-edited.pdf", "document-edited.pdf", "x" * 80 + "-edited.pdf", "merged.pdf"]


def test_report_of_a_job_with_many_bad_files(spark):
    files = spark.range(2000).select(F.lit(7).alias("job_id"), F.lit(0).alias("size"), F.col("id").cast("string").alias("name"))
    jobs = spark.createDataFrame([(7,), (8,)], "job_id int")
    got = {r.job_id: r for r in V.preflight_report(jobs, V.empty_files(jobs, files)).collect()}
    assert got[7].blocking == "files/empty_file:2000" and not got[7].ok
    assert got[8].blocking == "files/file_required:1"


def test_crop_box_syntax(spark):
    good = ["10,20,300,400", " 1 , 2.5, 3e1 ,40"]
    bad = ["", "1,2,3", "1,2,3,4,5", "a,b,c,d", "5,1,5,9", "1,2,inf,9"]
    df = spark.createDataFrame([(s,) for s in good + bad], "s string")
    assert [r.ok for r in df.select(V.crop_box_valid(F.col("s")).alias("ok")).collect()] == [True] * 2 + [False] * 6


@pytest.mark.parametrize("profile", ["native", "web"])
def test_batch_report_equals_the_fold_of_issue_rows(spark, profile):
    from quire.plans.validation_queries import OPTION_EXPRESSIONS

    rng = random.Random(5)
    kinds = [("pdf_edit", "merge"), ("pdf_edit", "edit"), ("pdf_translate", ""), ("ocr", "")]
    base = spark.createDataFrame(
        [(j, *rng.choice(kinds), rng.choice([10, 500, 5000])) for j in range(60)], "job_id long, kind string, edit_action string, input_limit long"
    )
    texts = spark.createDataFrame([(j, j, rng.choice(["x", "word " * 2000]), "en") for j in range(60)], "job_id long, doc_id long, text string, lang string")
    options = [F.expr(e).alias(k) for k, e in OPTION_EXPRESSIONS.items() if k not in ("kind", "edit_action")]
    jobs = base.join(texts.select("job_id", *options), "job_id")
    files = spark.createDataFrame(
        [(j, f"{i}.txt", rng.choice([-5, 0, 7, 400, 3000])) for j in range(60) for i in range(rng.choice([0, 1, 1, 2, 5]))],
        "job_id long, name string, size long",
    )
    want = V.preflight_report(
        jobs, V.batch_limits(files, jobs.select("job_id", "input_limit"), profile, max_files=4, text_limit=1000), V.empty_files(jobs, files),
        V.input_cardinality(jobs, files), V.option_issues(jobs),
        V.issues(jobs.filter("kind = 'pdf_translate'"), "translate", "remote_processing", severity="warning"),
    )
    got = V.batch_preflight(jobs, files, profile, max_files=4, text_limit=1000, options=True)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert V.batch_preflight(jobs.limit(0), files).count() == 0
