"""Sources, sinks, manifests and user functions."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quire.operators import plugins as U
from quire.sources import files as S
from quire.sources import results as R


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def test_inventory_reads_no_bytes(spark, sf_dir):
    df = S.file_inventory(spark, f"{sf_dir}/*.parquet")
    got = {r.name: (r.ext, r.size) for r in df.collect()}
    assert got == {n: (".parquet", os.path.getsize(f"{sf_dir}/{n}")) for n in os.listdir(sf_dir)}
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_inventory_leaves_links_out(spark, tmp_path):
    write(tmp_path / "plain name.txt", "x")
    os.symlink(tmp_path / "plain name.txt", tmp_path / "linked name.txt")
    assert [r.name for r in S.file_inventory(spark, str(tmp_path / "*.txt")).collect()] == ["plain name.txt"]


def test_inventory_leaves_files_of_directories_out(spark, tmp_path):
    for folder in ("b.txt", "c.txt/k=1", "d e"):
        (tmp_path / folder).mkdir(parents=True)
        write(tmp_path / folder / "inner.txt", "x")
    write(tmp_path / "a.txt", "x")
    names = lambda glob: sorted(r.name for r in S.file_inventory(spark, glob).collect())
    assert names(str(tmp_path / "*.txt")) == names(f"file://{tmp_path}/?.txt") == ["a.txt"]
    assert names(str(tmp_path / "*/*.txt")) == ["inner.txt", "inner.txt"]
    assert names(str(tmp_path / "d e")) == names(str(tmp_path / "d e/inner.txt")) == ["inner.txt"]


def test_one_text_file_per_result(spark, tmp_path):
    rows = [(1, "a b.md", "line\nline\n"), (1, "c=d/e.md", ""), (2, "007", "ü")]
    R.write_documents(spark.createDataFrame(rows, "job_id long, name string, text string"), str(tmp_path / "out"), layout="files")
    assert sorted(map(tuple, R.read_documents(spark, str(tmp_path / "out")).collect())) == rows


def test_result_files_have_a_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda rows: spark.createDataFrame(rows, "job_id long, name string, text string")
    rows = [(1, "a", "same"), (1, "a", "same"), (1, "a", None), (2, None, "x\r\n"), (3, "q?*[1]{}^\\\"'#%:", "y"), (4, "ü b.md", "z")]
    back = lambda df: sorted(map(str, df.collect()))
    R.write_documents(frame(rows), path, layout="files")
    want = sorted(str(r) for r in frame([(j, n, t or "") for j, n, t in rows]).collect())
    assert back(R.read_documents(spark, path)) == want and spark.read.parquet(path + "/_manifest").count() == len(rows)
    listed = spark.read.schema("value string, job_id bigint, name string").text(path, wholetext=True)
    assert back(listed.select("job_id", "name", F.regexp_replace("value", r"\n\z", "").alias("text"))) == want
    R.write_documents(frame([(1, "a", "same")]), path, layout="files", mode="append")
    assert R.read_documents(spark, path).count() == len(rows) + 1
    R.write_documents(frame([(9, "b", "new")]), path, layout="files")
    assert [tuple(r) for r in R.read_documents(spark, path).collect()] == [(9, "b", "new")]
    with pytest.raises(Exception):
        R.write_documents(frame(rows), path, layout="files", mode="error")


def test_text_with_bad_bytes(spark, tmp_path):
    write(tmp_path / "a.txt", b"ok \xff end")
    assert S.scan_text(spark, str(tmp_path / "*.txt")).first().text == "ok � end"
    with pytest.raises(Exception):
        S.scan_text(spark, str(tmp_path / "*.txt"), on_error="fail").collect()
    assert S.scan_text(spark, str(tmp_path / "*.txt"), max_bytes=3).count() == 0


def test_delimited(spark, tmp_path):
    good = write(tmp_path / "good.csv", 'name,value\n"A,B","He said ""yes"""\n"two\nlines",1\n')
    bad = write(tmp_path / "bad.csv", 'name,value\n"open,1\n')
    assert [tuple(r) for r in S.scan_delimited(spark, good).collect()] == [("A,B", 'He said "yes"'), ("two\nlines", "1")]
    found = S.unclosed_quotes(spark, str(tmp_path / "*.csv")).collect()
    assert [os.path.basename(r.path) for r in found] == [os.path.basename(bad)]


def test_json_is_one_whole_value(spark):
    rows = ['{"b":1,"a":[1,2]}', '{"a":1}}', "1],[2", "1, 2", '{"a":1} x', "not json", "[3]", '"s"', "null", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = [r.j for r in df.select("i", S.normalize_json(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == ['{"a":[1,2],"b":1}', '{"a":1}}', "1],[2", "1, 2", '{"a":1} x', "not json", "[3]", '"s"', "null", ""]
    with pytest.raises(Exception):
        df.filter("i = 5").select(S.normalize_json(F.col("t"), "fail")).collect()


def test_xml_does_not_read_files(spark, tmp_path):
    secret = write(tmp_path / "secret.txt", "TOP")
    doc = f'<?xml version="1.0"?><!DOCTYPE r [<!ENTITY xxe SYSTEM "file://{secret}">]><r><t>&xxe;</t></r>'
    df = spark.createDataFrame([(doc,), ("<r><t>fine</t></r>",)], "x string")
    got = [r.t for r in df.select(S.parse_xml(F.col("x"), "t string")["t"].alias("t")).collect()]
    assert got == [None, "fine"]
    path = write(tmp_path / "rows.xml", "<rows><row><t>a</t></row><row><t>b</t></row></rows>")
    assert [r.t for r in S.scan_xml(spark, path, "row", Ty.StructType([Ty.StructField("t", Ty.StringType())])).collect()] == ["a", "b"]


def test_glossary(spark):
    df = spark.createDataFrame([("a, b=c\n x => y \nk=v=w\n\n lone \r\na=>b,c",)], "text string")
    got = [(r.source_term, r.target_term) for r in S.scan_glossary(df).orderBy("line_no").collect()]
    assert got == [("a", "b=c"), ("x", "y"), ("k", "v=w"), ("lone", "lone"), ("a=>b", "c")]


def test_fingerprint_samples_both_ends(spark):
    small, big = b"x" * 8, bytes(range(256)) * 3
    df = spark.createDataFrame([(bytearray(small),), (bytearray(big),)], "c binary")
    got = [tuple(r.f) for r in df.select(R.result_fingerprint(F.col("c"), sample=4).alias("f")).collect()]
    assert got == [(8, hashlib.sha256(small).hexdigest()), (768, hashlib.sha256(big[:4] + big[-4:]).hexdigest())]


def test_newest_file_loses_to_preferred_token(spark):
    inv = spark.createDataFrame(
        [(1, "report-zh.pdf", 5), (1, "report-translated.pdf", 100), (1, "report.pdf", 200), (2, "report-zh.pdf", 5), (1, "other-mono.pdf", 300)],
        "run_id long, name string, mtime long",
    )
    runs = spark.createDataFrame([(1, "report", 90, "translated"), (2, "report", 90, "translated")], "run_id long, stem string, since long, mode string")
    assert {r.run_id: r.picked for r in R.pick_engine_output(inv, runs).collect()} == {1: "report-translated.pdf"}


def test_resolved_paths(spark):
    df = spark.createDataFrame([("/a//b/./c",), ("/a/b/../../c",), ("/../x",), ("/a/..b/c",)], "p string")
    assert [r.r for r in df.select(R.resolve_path(F.col("p")).alias("r")).collect()] == ["/a/b/c", "/c", "/x", "/a/..b/c"]


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.md", "x\ny"), (1, "b.md", "z")], "job_id long, name string, text string")
    R.write_documents(df, str(tmp_path / "files"), layout="files")
    back = spark.read.text(str(tmp_path / "files"), wholetext=True).collect()
    assert {(r.job_id, r.name, r.value) for r in back} == {(1, "a.md", "x\ny\n"), (1, "b.md", "z\n")}


def test_page_spec_table_function(spark):
    name = U.register_page_spec(spark)
    rows = lambda spec, n, mode: [r.page_no for r in spark.sql(f"SELECT * FROM {name}('{spec}', {n}, '{mode}') ORDER BY pos").collect()]
    assert rows("1,3-4,-2,9-", 10, "select") == [1, 2, 3, 4, 9, 10]
    assert rows("", 3, "select") == [1, 2, 3] and rows(",", 3, "select") == []
    assert rows("3-1,1,5", 4, "order") == [3, 2, 1, 1] and rows("", 3, "order") == []


def test_user_functions_keep_failures_apart(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id long, text string")

    def fn(row):
        return {"n": 1 // row["doc_id"]}

    got = {r.doc_id: (r.n, r.error) for r in U.map_documents(df, fn, Ty.StructType([Ty.StructField("n", Ty.LongType())])).collect()}
    assert got[0][1].startswith("ZeroDivisionError") and got[1] == (1, None) and got[4] == (0, None)
    images = df.select("doc_id", F.col("text").cast("binary").alias("content"))
    seen = U.recognize_pages(images, lambda c: [(c.decode(), 0.0, 0.0, 1.0, 1.0, 0.9)] * 2, ["doc_id"])
    assert seen.count() == 10
