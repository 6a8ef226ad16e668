"""Sources, sinks and manifests."""

from pyspark.sql import functions as F

from quire.plans import fixtures as X
from quire.plans.fixtures import FILES
from quire.plans.registry import query
from quire.session import checkpoint_folder
from quire.sources import files as S
from quire.sources import results as R


# The folder is that of the documents view; where its text does not tell, the one of the small tables.
@query(
    "s1_file_inventory",
    """WITH folder AS (SELECT coalesce(max(sql), '/root/testdata/sf0.01/documents.parquet') AS view_text FROM duckdb_views() WHERE view_name = 'documents' AND contains(sql, '/documents.parquet')),
f AS (SELECT filename, size FROM read_blob('/root/testdata/sf*/*.parquet'))
SELECT regexp_extract(filename, '([^/]+)$', 1) AS name, '.parquet' AS ext, size FROM f, folder
WHERE contains(view_text, regexp_replace(filename, '[^/]+$', '') || 'documents.parquet')""",
)
def s1(spark, sf):
    return S.file_inventory(spark, f"{sf}/*.parquet").select("name", "ext", "size")


@query(
    "s2_scan_text",
    """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || chr(65533) ELSE text END AS text FROM documents""",
)
def s2(spark, sf):
    raw = F.col("text").cast("binary")
    content = F.when(F.col("doc_id") % 9 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return X.table(spark, sf, "documents").select("doc_id", S.decode_text(content).alias("text"))


def _fresh(spark, name):
    import uuid

    return f"{checkpoint_folder(spark)}/quire/{name}-{uuid.uuid4().hex}"


@query("s3_scan_delimited", "SELECT doc_id, lang, text || ' \"q\", x' AS text FROM documents")
def s3(spark, sf):
    path = _fresh(spark, "delimited")
    d = X.table(spark, sf, "documents")
    d.select("doc_id", "lang", F.concat("text", F.lit(' "q", x')).alias("text")).write.option("header", True).option(
        "quoteAll", True
    ).option("escape", '"').csv(path)
    return S.scan_delimited(spark, path, schema="doc_id bigint, lang string, text string")


@query(
    "s3_unclosed_quotes",
    """WITH q AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' "open' WHEN doc_id % 3 = 1 THEN ' "a""b"' ELSE '' END AS t FROM documents)
SELECT doc_id, length(t) - length(replace(t, '"', '')) AS quotes FROM q WHERE (length(t) - length(replace(t, '"', ''))) % 2 = 1""",
)
def s3_quotes(spark, sf):
    k = F.col("doc_id") % 3
    tail = F.when(k == 0, F.lit(' "open')).when(k == 1, F.lit(' "a""b"')).otherwise(F.lit(""))
    lines = X.table(spark, sf, "documents").select(
        "doc_id", F.explode(F.split(F.concat("text", tail), "\n")).alias("value")
    )
    return S.odd_quotes(lines, "doc_id")


@query(
    "s4_normalize_json",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN props || '}'
       ELSE json(CASE WHEN event_id % 7 = 1 THEN '{"a":1,"b":' || props || '}' ELSE props END)::VARCHAR END AS props FROM events""",
)
def s4(spark, sf):
    k = F.col("event_id") % 7
    raw = (
        F.when(k == 0, F.concat("props", F.lit("}")))
        .when(k == 1, F.concat(F.lit('{ "b": '), F.col("props"), F.lit(', "a": 1}')))
        .otherwise(F.col("props"))
    )
    return X.table(spark, sf, "events").select("event_id", S.normalize_json(raw).alias("props"))


@query(
    "s5_scan_xml",
    """SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE text END AS text FROM conversations""",
)
def s5(spark, sf):
    from quire.functions.text import escape_html

    c = X.table(spark, sf, "conversations")
    hostile = F.lit('<?xml version="1.0"?><!DOCTYPE t [<!ENTITY xxe SYSTEM "file:///etc/hostname">]>')
    body = F.when(F.col("conv_id") % 5 == 0, F.lit("&xxe;")).otherwise(escape_html(F.col("text")))
    xml = F.concat(
        F.when(F.col("conv_id") % 5 == 0, hostile).otherwise(F.lit("")),
        F.lit("<turn><text>"),
        body,
        F.lit("</text></turn>"),
    )
    parsed = S.parse_xml(xml, "text string")
    return c.select("conv_id", "turn", "role", parsed["text"].alias("text"))


RESULTS = f"""{FILES},
results AS (SELECT job_id, doc_id, job_id % 5 = 0 AS restored,
   CASE doc_id % 4 WHEN 0 THEN '/in/' || job_id || '/' || name WHEN 1 THEN '/out//' || job_id || '/../../in/' || job_id || '/./' || name
        ELSE '/out/' || job_id || '/' || name END AS destination FROM files)"""


def _results(spark, sf):
    f = X.files(spark, sf)
    job, k = F.col("job_id").cast("string"), F.col("doc_id") % 4
    inp = F.concat(F.lit("/in/"), job, F.lit("/"), "name")
    dest = (
        F.when(k == 0, inp)
        .when(k == 1, F.concat(F.lit("/out//"), job, F.lit("/../../in/"), job, F.lit("/./"), "name"))
        .otherwise(F.concat(F.lit("/out/"), job, F.lit("/"), "name"))
    )
    r = f.select("job_id", dest.alias("destination"), (F.col("job_id") % 5 == 0).alias("restored"))
    return r, f.select("job_id", inp.alias("path"))


@query(
    "s6_protect_originals",
    f"""WITH {RESULTS}
SELECT r.job_id, r.destination, CASE WHEN r.doc_id % 4 < 2 THEN CASE WHEN restored THEN 'existing_file' ELSE 'original_file' END ELSE 'ok' END AS verdict
FROM results r""",
)
def s6(spark, sf):
    r, inputs = _results(spark, sf)
    return R.protect_originals(r, inputs, inputs)


@query(
    "s7_scan_glossary",
    """WITH src AS (SELECT item_id, string_split(CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, ',', ' =>') ELSE replace(text, ',', '=') END, chr(10)) AS ls FROM benchmark),
l AS (SELECT item_id, unnest(range(0, len(ls))) AS line_no, trim(unnest(ls), ' ' || chr(9) || chr(13)) AS s FROM src),
c AS (SELECT *, CASE WHEN contains(s, ',') THEN ',' WHEN contains(s, '=>') THEN '=>' WHEN contains(s, '=') THEN '=' END AS m FROM l WHERE s <> '')
SELECT item_id, line_no::INTEGER AS line_no,
       CASE WHEN m IS NULL THEN s ELSE trim(substr(s, 1, instr(s, m) - 1), ' ' || chr(9)) END AS source_term,
       CASE WHEN m IS NULL THEN s ELSE trim(substr(s, instr(s, m) + length(m)), ' ' || chr(9)) END AS target_term FROM c""",
)
def s7(spark, sf):
    k = F.col("item_id") % 3
    text = (
        F.when(k == 0, F.col("text"))
        .when(k == 1, F.replace(F.col("text"), F.lit(","), F.lit(" =>")))
        .otherwise(F.replace(F.col("text"), F.lit(","), F.lit("=")))
    )
    b = X.table(spark, sf, "benchmark").select("item_id", text.alias("text"))
    return S.scan_glossary(b, keep=["item_id"])


@query(
    "s8_write_documents",
    f"WITH {FILES} SELECT job_id, name || '.md' AS name, d.text FROM files f JOIN documents d USING (doc_id)",
)
def s8(spark, sf):
    path = _fresh(spark, "results")
    d = X.table(spark, sf, "documents").select("doc_id", "text")
    out = X.files(spark, sf).join(d, "doc_id").select("job_id", F.concat("name", F.lit(".md")).alias("name"), "text")
    R.write_documents(out, path)
    return spark.read.parquet(path)


@query(
    "s8_one_text_per_document",
    f"WITH {FILES} SELECT job_id, name || '.md' AS name, d.text FROM files f JOIN documents d USING (doc_id)",
)
def s8_files(spark, sf):
    """One text file per result, read back from its own folder."""
    path = _fresh(spark, "result-files")
    d = X.table(spark, sf, "documents").select("doc_id", "text")
    R.write_documents(X.files(spark, sf).join(d, "doc_id").select("job_id", F.concat("name", F.lit(".md")).alias("name"), "text"), path, "files")
    return R.read_documents(spark, path)


KINDS = ["convert", "extract_markdown", "ocr"]
OUTPUTS = f"""{FILES},
outputs AS (SELECT doc_id // 4 + CASE WHEN doc_id % 4 = 0 THEN 1000000000 ELSE 0 END AS job_id,
  (['convert','extract_markdown','ocr'])[(doc_id // 4) % 3 + 1] AS kind, name, size FROM files)"""


def _outputs(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.expr("doc_id div 4") % 3 + 1).cast("int"))
    lone = F.when(F.col("doc_id") % 4 == 0, F.lit(1000000000)).otherwise(F.lit(0))
    return X.files(spark, sf).select((F.expr("doc_id div 4") + lone).alias("job_id"), kind.alias("kind"), "name", "size")


@query(
    "s9_bundle_manifest",
    f"""WITH {OUTPUTS}
SELECT job_id, kind, CASE WHEN count(*) = 1 THEN min(name) WHEN kind = 'convert' THEN 'converted-files.zip'
   WHEN kind = 'ocr' THEN 'ocr-files.zip' ELSE 'markdown-files.zip' END AS artifact, count(*) AS members, sum(size)::BIGINT AS size
FROM outputs GROUP BY job_id, kind""",
)
def s9(spark, sf):
    return R.bundle_manifest(_outputs(spark, sf))


FP = """fp AS (SELECT doc_id, strlen(text) AS byte_count, CASE WHEN strlen(text) <= 1024 THEN sha256(text)
   ELSE sha256((encode(text))[1:512] || (encode(text))[strlen(text) - 511:strlen(text)]) END AS sample_sha256 FROM documents)"""


@query("s10_result_fingerprint", f"WITH {FP} SELECT doc_id, byte_count, sample_sha256 FROM fp")
def s10(spark, sf):
    fp = R.result_fingerprint(F.col("text").cast("binary"), sample=512)
    return X.table(spark, sf, "documents").select("doc_id", fp.alias("fp")).select("doc_id", "fp.*")


@query(
    "s11_verify_results",
    f"""WITH {FP},
m AS (SELECT 'out-' || doc_id AS output, CASE WHEN doc_id % 11 = 1 THEN -1 WHEN doc_id % 11 = 2 THEN byte_count + 1 ELSE byte_count END AS byte_count,
             CASE WHEN doc_id % 11 = 3 THEN 'xyz' WHEN doc_id % 11 = 4 THEN upper(sample_sha256) ELSE sample_sha256 END AS sample_sha256 FROM fp WHERE doc_id % 11 <> 5),
a AS (SELECT 'out-' || doc_id AS output, byte_count, sample_sha256, CASE WHEN doc_id % 11 = 7 THEN 0 WHEN doc_id % 2 = 0 THEN 3 END AS pages FROM fp WHERE doc_id % 11 <> 6)
SELECT coalesce(m.output, a.output) AS output,
  CASE WHEN m.output IS NULL THEN 'no_receipt' WHEN m.byte_count < 0 OR NOT regexp_matches(m.sample_sha256, '^[0-9A-Fa-f]{{64}}$') THEN 'invalid_receipt'
       WHEN a.output IS NULL THEN 'missing' WHEN a.pages < 1 THEN 'no_pages'
       WHEN m.byte_count = a.byte_count AND lower(m.sample_sha256) = a.sample_sha256 THEN 'ok' ELSE 'mismatch' END AS verdict
FROM m FULL JOIN a ON m.output = a.output""",
)
def s11(spark, sf):
    fp = s10(spark, sf).withColumn("output", F.concat(F.lit("out-"), F.col("doc_id").cast("string")))
    k = F.col("doc_id") % 11
    manifest = fp.filter(k != 5).select(
        "output",
        F.when(k == 1, F.lit(-1)).when(k == 2, F.col("byte_count") + 1).otherwise(F.col("byte_count")).alias("byte_count"),
        F.when(k == 3, F.lit("xyz")).when(k == 4, F.upper("sample_sha256")).otherwise(F.col("sample_sha256")).alias("sample_sha256"),
    )
    actual = fp.filter(k != 6).select(
        "output", "byte_count", "sample_sha256", F.when(k == 7, F.lit(0)).when(F.col("doc_id") % 2 == 0, F.lit(3)).alias("pages")
    )
    return R.verify_results(manifest, actual)


@query("s12_source_fingerprint", "SELECT doc_id, sha256(text) AS source_sha256 FROM documents")
def s12(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", R.source_fingerprint(F.col("text").cast("binary")).alias("source_sha256")
    )


INVENTORY = """inv AS (SELECT doc_id // 8 AS run_id, 'report' || (['', '-zh', '-translated', '-mono', '-dual', 'x-bilingual', '', ''])[doc_id % 8 + 1]
   || CASE WHEN doc_id % 8 = 6 THEN '.txt' WHEN doc_id % 8 = 7 THEN '-2.pdf' ELSE '.pdf' END AS name,
   ((doc_id * 7919) % 1000)::BIGINT AS mtime FROM documents),
runs AS (SELECT DISTINCT doc_id // 8 AS run_id, 'report' AS stem, CASE WHEN (doc_id // 8) % 3 = 0 THEN NULL ELSE ((doc_id // 8) * 37) % 900 END AS since,
   CASE WHEN (doc_id // 8) % 2 = 0 THEN 'bilingual' ELSE 'translated' END AS mode FROM documents)"""


@query(
    "s13_pick_engine_output",
    f"""WITH {INVENTORY},
c AS (SELECT i.run_id, name, mtime, lower(regexp_replace(name, '[.][^.]+$', '')) AS st, mode FROM inv i JOIN runs r USING (run_id)
      WHERE starts_with(name, stem) AND suffix(name, '.pdf') AND (since IS NULL OR mtime >= since - 1)),
k AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS candidates, row_number() OVER (PARTITION BY run_id ORDER BY
   CASE WHEN mode = 'bilingual' THEN CASE WHEN contains(st, 'dual') THEN 0 WHEN contains(st, 'bilingual') THEN 1 ELSE 9 END
        ELSE CASE WHEN contains(st, 'mono') THEN 0 WHEN contains(st, 'translated') THEN 1 WHEN contains(st, 'zh') THEN 2 ELSE 9 END END, mtime DESC, name) AS rn FROM c)
SELECT run_id, name AS picked, candidates FROM k WHERE rn = 1""",
)
def s13(spark, sf):
    d = X.table(spark, sf, "documents")
    k = F.col("doc_id") % 8
    run = F.expr("doc_id div 8")
    tags = ["", "-zh", "-translated", "-mono", "-dual", "x-bilingual", "", ""]
    tag = F.element_at(F.array(*[F.lit(t) for t in tags]), (k + 1).cast("int"))
    ext = F.when(k == 6, F.lit(".txt")).when(k == 7, F.lit("-2.pdf")).otherwise(F.lit(".pdf"))
    inv = d.select(
        run.alias("run_id"), F.concat(F.lit("report"), tag, ext).alias("name"), (F.col("doc_id") * 7919 % 1000).alias("mtime")
    )
    runs = d.select(run.alias("run_id")).distinct().select(
        "run_id",
        F.lit("report").alias("stem"),
        F.when(F.col("run_id") % 3 != 0, F.col("run_id") * 37 % 900).alias("since"),
        F.when(F.col("run_id") % 2 == 0, F.lit("bilingual")).otherwise(F.lit("translated")).alias("mode"),
    )
    return R.pick_engine_output(inv, runs)


@query(
    "s14_order_inputs",
    f"""WITH {FILES},
o AS (SELECT job_id, lower(name) AS k, max(9 - ord - 1) AS pos FROM files WHERE ord <> 3 GROUP BY job_id, lower(name)),
n AS (SELECT job_id, count(*) AS n FROM files WHERE ord <> 3 GROUP BY job_id)
SELECT f.job_id, f.doc_id, f.name, coalesce(o.pos, n.n, 0) AS sort_pos FROM files f
LEFT JOIN o ON o.job_id = f.job_id AND o.k = lower(f.name) LEFT JOIN n ON n.job_id = f.job_id""",
)
def s14(spark, sf):
    f = X.files(spark, sf)
    order = f.filter("ord <> 3").select("job_id", "name", (9 - F.col("ord")).alias("ord"))
    return R.order_inputs(f, order).select("job_id", "doc_id", "name", "sort_pos").orderBy("job_id", "sort_pos", "name")
