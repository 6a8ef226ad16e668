"""Preflight checks over batches derived from ``documents``."""

from pyspark.sql import functions as F

from quire import catalog as C
from quire.functions import text as T
from quire.operators import validate as V
from quire.plans import fixtures as X
from quire.plans.fixtures import DOC_PAGES, FILES
from quire.plans.registry import query, values_sql


def _routes_sql(profile):
    return values_sql("routes", C.ROUTE_COLUMNS, C.route_rows(profile))


def _accept_sql(profile):
    return values_sql("accepts", ["route_no", "ext"], C.accept_rows(profile))


def jobs(spark, sf):
    """Jobs of the corpus, plus one in five that never received a file."""
    d = X.table(spark, sf, "documents").select(F.expr("doc_id div 8").alias("job_id")).distinct()
    twin = F.when(F.col("job_id") % 5 == 0, F.col("job_id") + 1000000000)
    all_jobs = d.select(F.explode(F.array_compact(F.array("job_id", twin))).alias("job_id"))
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    return all_jobs.select(
        "job_id",
        pick(["pdf_edit", "pdf_edit", "pdf_translate", "ocr"], F.col("job_id") % 4).alias("kind"),
        F.when(F.col("job_id") % 4 == 0, "merge").otherwise("edit").alias("edit_action"),
    )


JOBS = """base_jobs AS (SELECT DISTINCT doc_id // 8 AS job_id FROM documents),
all_jobs AS (SELECT job_id FROM base_jobs UNION ALL SELECT job_id + 1000000000 FROM base_jobs WHERE job_id % 5 = 0),
jobs AS (SELECT job_id, (['pdf_edit','pdf_edit','pdf_translate','ocr'])[job_id % 4 + 1] AS kind,
         CASE WHEN job_id % 4 = 0 THEN 'merge' ELSE 'edit' END AS edit_action FROM all_jobs)"""


@query(
    "v1_route_catalog",
    f"""WITH {_routes_sql('native')}, {_accept_sql('native')}, {FILES},
c AS (SELECT lower(regexp_extract(name, '([.][^.]+)$', 1)) AS ext, count(*) AS n, sum(size)::BIGINT AS bytes FROM files GROUP BY 1)
SELECT r.route_no::BIGINT AS route_no, r.source, r.target, r.kind, coalesce(sum(c.n), 0)::BIGINT AS n_files, coalesce(sum(c.bytes), 0)::BIGINT AS bytes
FROM routes r JOIN accepts a USING (route_no) LEFT JOIN c ON c.ext = a.ext GROUP BY ALL""",
)
def v1(spark, sf):
    """The catalogue with the corpus files each route could take."""
    counted = (
        X.files(spark, sf)
        .groupBy(T.suffix(F.col("name")).alias("ext"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    )
    return (
        C.routes(spark)
        .select("route_no", "source", "target", "kind")
        .join(C.accepts(spark), "route_no")
        .join(counted, "ext", "left")
        .groupBy("route_no", "source", "target", "kind")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    )


ASKED = ["pdf", "word", "ppt", "excel", "md", "html", "image", "data", "translated_pdf", "ocr", "video"]
ASKED_KINDS = ["convert", "extract_markdown", "pdf_edit", "pdf_translate", "ocr", "office_convert", "text_to_pdf", "image_to_pdf"]


def _requests(spark, sf):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    d = F.col("doc_id")
    return X.table(spark, sf, "documents").select(
        d.alias("job_id"),
        pick(ASKED, d % 11).alias("source"),
        pick(ASKED, F.expr("doc_id div 11") % 11).alias("target"),
        pick(ASKED_KINDS, F.expr("doc_id div 5") % 8).alias("kind"),
    )


REQUESTS = f"""requests AS (SELECT doc_id AS job_id, ({ASKED})[doc_id % 11 + 1] AS source, ({ASKED})[(doc_id // 11) % 11 + 1] AS target,
  ({ASKED_KINDS})[(doc_id // 5) % 8 + 1] AS kind FROM documents)"""


def _resolve_sql(profile):
    kind = "AND r.kind = q.kind" if profile == "native" else ""
    return f"""WITH {_routes_sql(profile)}, {values_sql('fmts', ['format', 'label', 'input'], C.formats(profile))}, {REQUESTS}
SELECT q.job_id, q.source, q.target, q.kind, r.route_no::BIGINT AS route_no,
  CASE WHEN r.route_no IS NOT NULL THEN 'supported' WHEN q.source IN (SELECT format FROM fmts) AND q.target IN (SELECT format FROM fmts) THEN 'disabled'
       ELSE 'unknown' END AS outcome
FROM requests q LEFT JOIN routes r ON r.source = q.source AND r.target = q.target {kind}"""


@query("v2_resolve_route_native", _resolve_sql("native"))
def v2_native(spark, sf):
    return V.resolve_route(_requests(spark, sf), "native").select("job_id", "source", "target", "kind", "route_no", "outcome")


@query("v2_resolve_route_web", _resolve_sql("web"))
def v2_web(spark, sf):
    return V.resolve_route(_requests(spark, sf), "web").select("job_id", "source", "target", "kind", "route_no", "outcome")


def _routed_files(spark, sf):
    return X.files(spark, sf).withColumn("route_no", F.col("job_id") % 18)


@query(
    "v3_accept_filter",
    f"""WITH {_accept_sql('web')}, {FILES}
SELECT f.job_id, f.doc_id, f.name, a.ext IS NOT NULL AS accepted FROM files f
LEFT JOIN accepts a ON a.route_no = f.job_id % 18 AND a.ext = lower(regexp_extract(f.name, '([.][^.]+)$', 1))""",
)
def v3(spark, sf):
    return V.accept_flag(_routed_files(spark, sf), "web").select("job_id", "doc_id", "name", "accepted")


LIMITS = "limits AS (SELECT DISTINCT job_id, CASE WHEN job_id % 2 = 0 THEN 18000 ELSE 30000 END AS input_limit FROM files)"


def _limits(spark, sf):
    return X.files(spark, sf).select("job_id").distinct().withColumn(
        "input_limit", F.when(F.col("job_id") % 2 == 0, F.lit(18000)).otherwise(F.lit(30000))
    )


BATCH_ISSUES = f"""{FILES}, {LIMITS},
t AS (SELECT job_id, count(*) AS n, sum(greatest(size, 0))::BIGINT AS total FROM files GROUP BY job_id)"""


@query(
    "v4_batch_limits",
    f"""WITH {FILES}, {LIMITS}, f AS (SELECT * FROM files UNION ALL SELECT * FROM files WHERE job_id % 3 = 0 AND doc_id % 8 = 0),
t AS (SELECT job_id, count(*) AS n, sum(greatest(size, 0))::BIGINT AS total FROM f GROUP BY job_id)
SELECT job_id, 'too_many_files' AS code, n::VARCHAR AS detail FROM t WHERE n > 8
UNION ALL SELECT job_id, 'upload_too_large', total::VARCHAR FROM t JOIN limits USING (job_id) WHERE n <= 8 AND total > input_limit
UNION ALL SELECT job_id, 'text_too_large', name FROM f WHERE size > 9000""",
)
def v4(spark, sf):
    # A third of the jobs get one file more, so that both limits are met and missed.
    f = X.files(spark, sf)
    f = f.unionByName(f.filter("job_id % 3 = 0 and doc_id % 8 = 0"))
    return V.batch_limits(f, _limits(spark, sf), "native", max_files=8, text_limit=9000).select("job_id", "code", "detail")


@query(
    "v5_missing_or_empty_files",
    f"""WITH {FILES}, {JOBS}
SELECT job_id, 'file_required' AS code, '' AS detail FROM jobs WHERE job_id NOT IN (SELECT job_id FROM files)
UNION ALL SELECT job_id, 'empty_file', name FROM files WHERE size <= 0""",
)
def v5(spark, sf):
    return V.empty_files(jobs(spark, sf), X.files(spark, sf)).select("job_id", "code", "detail")


CARD = f"""{FILES}, {JOBS}, n AS (SELECT job_id, count(*) AS n FROM files GROUP BY job_id),
card AS (SELECT j.job_id, coalesce(n, 0) AS n, CASE WHEN kind = 'pdf_edit' AND edit_action = 'merge' AND coalesce(n, 0) < 2 THEN 'merge_requires_files'
  WHEN (kind = 'pdf_edit' AND edit_action <> 'merge' OR kind = 'pdf_translate') AND coalesce(n, 0) <> 1 THEN 'single_file_required' END AS code
  FROM jobs j LEFT JOIN n USING (job_id))"""


@query("v6_input_cardinality", f"WITH {CARD} SELECT job_id, code, n::VARCHAR AS detail FROM card WHERE code IS NOT NULL")
def v6(spark, sf):
    return V.input_cardinality(jobs(spark, sf), X.files(spark, sf)).select("job_id", "code", "detail")


# Which tools a machine has: a fixed sample environment.
AVAILABLE = [("pymupdf", True), ("pillow", True), ("libreoffice", False), ("playwright", True), ("markitdown", False),
             ("tesseract", False), ("ocrmypdf", False), ("deepseek", True), ("openai", False)]


def _routed_jobs(spark, sf):
    d = X.table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"),
        (F.col("doc_id") % 18).alias("route_no"),
        F.when(F.col("doc_id") % 3 == 0, "openai").when(F.col("doc_id") % 3 == 1, "").otherwise("deepseek").alias("provider"),
        F.when(F.col("doc_id") % 4 == 1, "text").otherwise("searchable_pdf").alias("output_format"),
    )
    return d.join(F.broadcast(C.routes(spark, "web").select("route_no", "kind")), "route_no")


REQS = f"""{_routes_sql('web')}, {values_sql('needs', ['route_no', 'pos', 'dependency', 'level'], C.requirement_rows('web'))},
{values_sql('deps', ['dependency', 'available'], AVAILABLE)},
j AS (SELECT doc_id AS job_id, doc_id % 18 AS route_no, CASE doc_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN '' ELSE 'deepseek' END AS provider,
      CASE WHEN doc_id % 4 = 1 THEN 'text' ELSE 'searchable_pdf' END AS output_format FROM documents),
nr AS (SELECT j.job_id, n.pos, n.level, CASE WHEN r.kind = 'pdf_translate' AND n.dependency IN ('deepseek', 'openai')
         THEN CASE WHEN provider = '' THEN 'deepseek' ELSE provider END ELSE n.dependency END AS dependency
       FROM j JOIN routes r USING (route_no) JOIN needs n USING (route_no)
       WHERE NOT (r.kind = 'ocr' AND output_format = 'text' AND n.dependency = 'ocrmypdf')),
na AS (SELECT nr.*, coalesce(available, FALSE) AS ok, CASE WHEN nr.dependency IN ('deepseek', 'openai') THEN 'missing_provider' ELSE 'missing_dependency' END AS code
       FROM nr LEFT JOIN deps USING (dependency)),
req_issues AS (SELECT job_id, 'blocking' AS severity, code, dependency AS detail FROM na WHERE level = 'required' AND NOT ok
UNION ALL SELECT job_id, 'warning', 'optional_dependency_missing', dependency FROM na WHERE level = 'optional' AND NOT ok
UNION ALL SELECT job_id, 'blocking', arg_min(code, pos), arg_min(dependency, pos) FROM na WHERE level NOT IN ('required', 'optional')
          GROUP BY job_id, level HAVING NOT bool_or(ok))"""


def _deps(spark):
    return C.literal_table(spark, "dependency string, available boolean", AVAILABLE)


@query("v7_requirement_check", f"WITH {REQS} SELECT job_id, severity, code, detail FROM req_issues")
def v7(spark, sf):
    return V.requirement_check(_routed_jobs(spark, sf), _deps(spark), "web").select("job_id", "severity", "code", "detail")


# One option row per document; the same expressions serve Spark and the SQL.
OPTION_EXPRESSIONS = {
    "kind": "CASE doc_id % 5 WHEN 1 THEN 'pdf_translate' WHEN 2 THEN 'ocr' WHEN 3 THEN 'extract_markdown' ELSE 'pdf_edit' END",
    "edit_action": "CASE doc_id % 13 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' ELSE 'edit' END",
    "delete_pages": "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '2,4-6' ELSE '6-4' END",
    "rotate_pages": "CASE WHEN doc_id % 4 = 0 THEN '1-2' ELSE ' ' END",
    "rotate_degrees": "CASE doc_id % 6 WHEN 0 THEN '45' WHEN 1 THEN '-90' ELSE '90' END",
    "reorder_pages": "CASE WHEN doc_id % 29 = 0 THEN concat(repeat('1,', 3000), '1') ELSE '3,1,2' END",
    "crop_pages": "CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '' END",
    "crop_box": "CASE WHEN doc_id % 5 = 0 THEN '10,20,5,400' WHEN doc_id % 5 = 1 THEN 'a,b,c,d' WHEN doc_id % 7 = 0 THEN repeat('1', 300) ELSE '10, 20,300,400' END",
    "replace_find": "CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN left(text, 600) ELSE 'x' END",
    "replace_with": "CASE WHEN doc_id % 8 = 0 THEN 'y' ELSE '' END",
    "watermark": "text",
    "provider": "CASE doc_id % 3 WHEN 0 THEN 'deepseek' WHEN 1 THEN 'openai' ELSE 'other' END",
    "output_mode": "CASE WHEN doc_id % 4 = 0 THEN 'mono' ELSE 'translated' END",
    "source_language": "CASE doc_id % 10 WHEN 0 THEN '  ' WHEN 1 THEN concat('en', chr(7)) ELSE lang END",
    "target_language": "CASE WHEN doc_id % 9 = 0 THEN repeat('z', 65) ELSE 'zh' END",
    "glossary": "repeat(text, 3)",
    "ocr_output_format": "CASE WHEN doc_id % 7 = 0 THEN 'html' ELSE 'text' END",
    "ocr_language": "CASE WHEN doc_id % 6 = 0 THEN concat('en', chr(10), 'fr') ELSE 'zh,en' END",
}


def _options(spark, sf):
    cols = [F.expr(e).alias(k) for k, e in OPTION_EXPRESSIONS.items()]
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), *cols)


_SYNTAX = (
    "(trim({f}, ' ') <> '' AND list_bool_or(list_transform(string_split(trim({f}, ' '), ','), lambda p: "
    "NOT regexp_matches(trim(p, ' '), '^[0-9]+(-[0-9]+)?$') OR coalesce(try_cast(split_part(trim(p, ' '), '-', 1) AS BIGINT) > "
    "try_cast(split_part(trim(p, ' '), '-', -1) AS BIGINT), TRUE))))"
)


def _option_rules():
    single = "kind = 'pdf_edit' AND edit_action = 'edit'"
    translate = "kind = 'pdf_translate'"
    rules = [("kind = 'pdf_edit' AND edit_action NOT IN ('edit', 'merge')", "invalid_edit_action", "edit_action")]
    for f in ("delete_pages", "rotate_pages", "reorder_pages", "crop_pages"):
        rules.append((f"{single} AND length({f}) > 4096", "page_selection_too_large", f))
        rules.append((f"{single} AND length({f}) <= 4096 AND {_SYNTAX.format(f=f)}", "invalid_page_selection", f))
    rules += [
        (f"{single} AND trim(rotate_pages, ' ') <> '' AND rotate_degrees NOT IN ('90','180','270','-90','-180','-270')", "invalid_rotation", "rotate_degrees"),
        (f"{single} AND crop_pages <> '' AND length(crop_box) > 256", "crop_box_too_large", "crop_box"),
        (f"{single} AND crop_pages <> '' AND length(crop_box) <= 256 AND crop_box <> '10, 20,300,400'", "invalid_crop_box", "crop_box"),
        (f"{single} AND (length(replace_find) > 512 OR contains(replace_find, chr(10)) OR (replace_find = '' AND replace_with <> ''))", "invalid_text_replacement", "replace_find"),
        (f"{single} AND length(watermark) > 512", "watermark_too_large", "watermark"),
        (f"{translate} AND provider = 'other'", "invalid_provider", "provider"),
        (f"{translate} AND output_mode = 'mono'", "invalid_translation_output", "output_mode"),
        (f"{translate} AND (trim(source_language, ' ') = '' OR contains(source_language, chr(7)))", "invalid_source_language", "source_language"),
        (f"{translate} AND length(target_language) > 64", "invalid_target_language", "target_language"),
        (f"{translate} AND length(glossary) > 20000", "glossary_too_large", "glossary"),
        ("kind = 'ocr' AND ocr_output_format = 'html'", "invalid_ocr_output", "ocr_output_format"),
        ("kind IN ('pdf_translate', 'ocr', 'extract_markdown') AND contains(ocr_language, chr(10))", "invalid_ocr_language", "ocr_language"),
    ]
    return " UNION ALL ".join(f"SELECT job_id, '{code}' AS code, '{field}' AS detail FROM opts WHERE {when}" for when, code, field in rules)


OPTS = "opts AS (SELECT doc_id AS job_id, " + ", ".join(f"{e} AS {k}" for k, e in OPTION_EXPRESSIONS.items()) + " FROM documents)"
OPTION_ISSUES = f"{OPTS}, opt_issues AS ({_option_rules()})"


@query("v8_option_issues", f"WITH {OPTION_ISSUES} SELECT job_id, code, detail FROM opt_issues")
def v8(spark, sf):
    return V.option_issues(_options(spark, sf)).select("job_id", "code", "detail")


@query(
    "v8_block_edits",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN FALSE WHEN doc_id % 5 = 0 THEN FALSE ELSE
   length(repeat(text, 5)) + 1 <= 20000 END AS valid FROM documents""",
)
def v8_blocks(spark, sf):
    # One astral character counts as two UTF-16 units, hence the +1 in the SQL.
    d = X.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.repeat(F.concat("text"), F.lit(5)), F.lit("")).alias("text"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(301.0)).otherwise(F.lit(12.0)).alias("font_size"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(100.0)).alias("width"),
        F.lit(1.0).alias("x"),
        F.lit(2.0).alias("y"),
    )
    d = d.withColumn("text", F.concat("text", F.lit("x")))
    return V.block_edit_valid(d).select("doc_id", "valid")


@query(
    "v9_preflight_report",
    f"""WITH {BATCH_ISSUES}, {JOBS},
n AS (SELECT job_id, count(*) AS n FROM files GROUP BY job_id),
t0 AS (SELECT job_id, count(*) AS n, sum(greatest(size, 0))::BIGINT AS total FROM files GROUP BY job_id),
i AS (SELECT job_id, 'limits' AS stage, 'too_many_files' AS code FROM t0 WHERE n > 7
  UNION ALL SELECT job_id, 'limits', 'upload_too_large' FROM t0 JOIN limits USING (job_id) WHERE n <= 7 AND total > input_limit
  UNION ALL SELECT job_id, 'limits', 'text_too_large' FROM files WHERE size > 9000
  UNION ALL SELECT job_id, 'files', 'file_required' FROM jobs WHERE job_id NOT IN (SELECT job_id FROM files)
  UNION ALL SELECT job_id, 'files', 'empty_file' FROM files WHERE size <= 0
  UNION ALL SELECT j.job_id, 'cardinality', CASE WHEN edit_action = 'merge' THEN 'merge_requires_files' ELSE 'single_file_required' END
    FROM jobs j LEFT JOIN n USING (job_id) WHERE CASE WHEN kind = 'pdf_edit' AND edit_action = 'merge' THEN coalesce(n, 0) < 2
      WHEN kind IN ('pdf_edit', 'pdf_translate') THEN coalesce(n, 0) <> 1 ELSE FALSE END),
c AS (SELECT job_id, stage || '/' || code || ':' || count(*) AS line FROM i GROUP BY job_id, stage, code),
w AS (SELECT job_id, 'translate/remote_processing:1' AS line FROM jobs WHERE kind = 'pdf_translate')
SELECT j.job_id, (SELECT count(*) FROM c WHERE c.job_id = j.job_id) = 0 AS ok,
  coalesce((SELECT string_agg(line, ',' ORDER BY line) FROM c WHERE c.job_id = j.job_id), '') AS blocking,
  coalesce((SELECT string_agg(line, ',') FROM w WHERE w.job_id = j.job_id), '') AS warnings
FROM jobs j""",
)
def v9(spark, sf):
    limit = F.when(F.col("job_id") % 2 == 0, F.lit(18000)).otherwise(F.lit(30000))
    return V.batch_preflight(
        jobs(spark, sf).withColumn("input_limit", limit), X.files(spark, sf), "native", max_files=7, text_limit=9000
    )


@query(
    "v10_canonical_options",
    f"""WITH {values_sql('defaults', ['k', 'v'], C.OPTION_DEFAULTS)},
{values_sql('allowed', ['kind', 'k'], [(kind, k) for kind, ks in C.OPTION_KEYS.items() for k in ks])},
j AS (SELECT doc_id AS job_id, (['pdf_translate','pdf_edit','ocr','extract_markdown','office_convert'])[doc_id % 5 + 1] AS kind, lang, doc_id FROM documents),
given AS (SELECT job_id, kind, 'provider' AS k, 'openai' AS v FROM j UNION ALL SELECT job_id, kind, 'source_language', lang FROM j
  UNION ALL SELECT job_id, kind, 'watermark', 'w' || doc_id FROM j UNION ALL SELECT job_id, kind, 'ocr_language', lang FROM j
  UNION ALL SELECT job_id, kind, 'unknown', 'x' FROM j),
m AS (SELECT j.job_id, d.k, coalesce(g.v, d.v) AS v FROM j CROSS JOIN defaults d
  LEFT JOIN (SELECT g.* FROM given g JOIN allowed a ON a.kind = g.kind AND a.k = g.k) g ON g.job_id = j.job_id AND g.k = d.k)
SELECT job_id, string_agg(k || '=' || v, ';' ORDER BY k) AS options FROM m GROUP BY job_id""",
)
def v10(spark, sf):
    kinds = ["pdf_translate", "pdf_edit", "ocr", "extract_markdown", "office_convert"]
    d = X.table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 5 + 1).cast("int")).alias("kind"),
        F.create_map(
            F.lit("provider"), F.lit("openai"), F.lit("source_language"), F.col("lang"),
            F.lit("watermark"), F.concat(F.lit("w"), F.col("doc_id").cast("string")),
            F.lit("ocr_language"), F.col("lang"), F.lit("unknown"), F.lit("x"),
        ).alias("options"),
    )
    entries = F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return V.canonical_options(d).select("job_id", F.array_join(entries, ";").alias("options"))


@query(
    "v11_dependency_profile",
    f"""WITH {_routes_sql('web')}, {values_sql('eng', ['engine', 'dep_pos', 'dependency', 'note'], C.engine_rows())},
u AS (SELECT route_no, unnest(string_split(engines, ',')) AS engine, unnest(range(0, len(string_split(engines, ',')))) AS p FROM routes),
x AS (SELECT u.route_no, u.p, e.dep_pos, e.dependency, e.note FROM u JOIN eng e USING (engine)),
d AS (SELECT route_no, dependency, min(p * 100 + dep_pos) AS seen FROM x GROUP BY 1, 2),
n AS (SELECT route_no, note, min(p) AS seen FROM x GROUP BY 1, 2),
dl AS (SELECT route_no, string_agg(dependency, ',' ORDER BY seen) AS dependencies FROM d GROUP BY 1),
nl AS (SELECT route_no, string_agg(note, ' ' ORDER BY seen) AS license_note FROM n GROUP BY 1)
SELECT dl.route_no::BIGINT AS route_no, dependencies, license_note, (SELECT count(*) FROM documents WHERE doc_id % 18 = dl.route_no) AS n_jobs FROM dl JOIN nl USING (route_no)""",
)
def v11(spark, sf):
    """Profile of each route with the jobs of the corpus that depend on it."""
    n = X.table(spark, sf, "documents").groupBy((F.col("doc_id") % 18).alias("route_no")).agg(F.count(F.lit(1)).alias("n_jobs"))
    return V.dependency_profile(spark).join(n, "route_no", "left").withColumn("n_jobs", F.coalesce("n_jobs", F.lit(0)))


@query(
    "v12_translation_budget",
    f"""WITH {DOC_PAGES},
r AS (SELECT doc_id, page_no, length(text) AS n, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_no) AS run FROM doc_pages)
SELECT doc_id, count(*) AS n_pages, sum(n)::BIGINT AS n_chars, min(page_no) FILTER (WHERE run > 3000) AS break_page,
   CASE WHEN count(*) > 40 THEN 'too_many_pages' WHEN sum(n) > 3000 THEN 'too_many_chars' ELSE 'ok' END AS verdict
FROM r GROUP BY doc_id""",
)
def v12(spark, sf):
    return V.translation_budget(X.doc_pages(spark, sf), max_pages=40, max_chars=3000)


@query(
    "v13_dedup_imports",
    f"""WITH {FILES},
a AS (SELECT job_id, 0 AS side, ord, '/in/' || name AS path FROM files WHERE ord <= 5
  UNION ALL SELECT job_id, 1, ord, '/in//./' || name FROM files),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id, replace(path, '//./', '/') ORDER BY side, ord) AS rn FROM a)
SELECT job_id, side, ord, path FROM k WHERE rn = 1""",
)
def v13(spark, sf):
    f = X.files(spark, sf)
    old = f.filter("ord <= 5").select("job_id", "ord", F.concat(F.lit("/in/"), "name").alias("path"))
    new = f.select("job_id", "ord", F.concat(F.lit("/in//./"), "name").alias("path"))
    return V.dedup_imports(old, new).select("job_id", "side", "ord", "path")


# Upload order in one job; stems are compared, so report.pdf and report.md clash.
@query(
    "v14_unique_names",
    """WITH RECURSIVE f AS (SELECT doc_id // 8 AS job_id, doc_id % 8 + 1 AS ord, (['same','Same','same-2','other','same','x-1','x-1','X'])[(doc_id * 5) % 8 + 1] AS stem,
        (['.pdf','.md','.txt'])[doc_id % 3 + 1] AS ext FROM documents),
s AS (SELECT 0::BIGINT AS ord, job_id, []::VARCHAR[] AS used, ''::VARCHAR AS name, ''::VARCHAR AS unique_name FROM (SELECT DISTINCT job_id FROM f)
  UNION ALL
  SELECT f.ord, f.job_id, list_append(s.used, lower(CASE WHEN k.k = 1 THEN f.stem ELSE f.stem || '-' || k.k END)), f.stem || f.ext,
         CASE WHEN k.k = 1 THEN f.stem || f.ext ELSE f.stem || '-' || k.k || f.ext END
  FROM s JOIN f ON f.job_id = s.job_id AND f.ord = s.ord + 1,
  LATERAL (SELECT min(i) AS k FROM range(1, 20) t(i) WHERE NOT list_contains(s.used, lower(CASE WHEN i = 1 THEN f.stem ELSE f.stem || '-' || i END))) k)
SELECT job_id, ord, name, unique_name FROM s WHERE ord > 0""",
)
def v14(spark, sf):
    stems = ["same", "Same", "same-2", "other", "same", "x-1", "x-1", "X"]
    stem = F.element_at(F.array(*[F.lit(v) for v in stems]), (F.col("doc_id") * 5 % 8 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(v) for v in [".pdf", ".md", ".txt"]]), (F.col("doc_id") % 3 + 1).cast("int"))
    f = X.table(spark, sf, "documents").select(
        F.expr("doc_id div 8").alias("job_id"), (F.col("doc_id") % 8 + 1).alias("ord"), F.concat(stem, ext).alias("name")
    )
    return V.unique_names(f)


OUT_KINDS = ["pdf_edit", "pdf_edit", "ocr", "ocr", "office_convert", "extract_markdown", "pdf_translate", "pdf_translate", "image_to_pdf", "text_to_pdf"]


@query(
    "v15_output_name",
    f"""WITH j AS (SELECT doc_id AS job_id, doc_id, ({OUT_KINDS})[doc_id % 10 + 1] AS kind,
   CASE WHEN doc_id % 10 = 0 THEN 'merge' ELSE 'edit' END AS edit_action, CASE WHEN doc_id % 10 = 2 THEN 'text' ELSE 'searchable_pdf' END AS fmt,
   CASE WHEN doc_id % 10 = 6 THEN 'bilingual' ELSE 'translated' END AS mode, CASE WHEN doc_id % 4 = 0 THEN 'md' ELSE 'pdf' END AS target, doc_id % 3 + 1 AS n_inputs,
   CASE WHEN doc_id % 12 = 5 THEN '17--.pdf' ELSE doc_id || '-' || replace(left(split_part(text, chr(10), 1), 120), '.', '_') || '.docx' END AS first_name FROM documents),
s AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(first_name, '^[0-9]+-', ''), '[.][^.]+$', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}_ -]', '-', 'g'), '- ') AS b FROM j),
t AS (SELECT *, left(CASE WHEN b = '' THEN 'document' ELSE b END, 80) AS stem FROM s)
SELECT job_id, CASE WHEN kind = 'pdf_edit' AND edit_action = 'merge' THEN 'merged.pdf' WHEN kind = 'pdf_edit' THEN stem || '-edited.pdf'
  WHEN kind = 'ocr' THEN stem || CASE WHEN fmt = 'text' THEN '-ocr.txt' ELSE '-ocr.pdf' END
  WHEN kind = 'office_convert' AND target = 'md' OR kind = 'extract_markdown' THEN stem || '.md'
  WHEN kind = 'pdf_translate' THEN stem || CASE WHEN mode = 'bilingual' THEN '-bilingual.pdf' ELSE '-translated.pdf' END
  WHEN kind = 'image_to_pdf' AND n_inputs > 1 THEN 'images.pdf' ELSE stem || '.pdf' END AS output_name FROM t""",
)
def v15(spark, sf):
    d = F.col("doc_id")
    first_line = F.left(F.substring_index("text", "\n", 1), F.lit(120))
    j = X.table(spark, sf, "documents").select(
        d.alias("job_id"),
        F.element_at(F.array(*[F.lit(k) for k in OUT_KINDS]), (d % 10 + 1).cast("int")).alias("kind"),
        F.when(d % 10 == 0, "merge").otherwise("edit").alias("edit_action"),
        F.when(d % 10 == 2, "text").otherwise("searchable_pdf").alias("ocr_output_format"),
        F.when(d % 10 == 6, "bilingual").otherwise("translated").alias("output_mode"),
        F.when(d % 4 == 0, "md").otherwise("pdf").alias("target"),
        (d % 3 + 1).alias("n_inputs"),
        F.when(d % 12 == 5, F.lit("17--.pdf"))
        .otherwise(F.concat(d.cast("string"), F.lit("-"), F.replace(first_line, F.lit("."), F.lit("_")), F.lit(".docx")))
        .alias("first_name"),
    )
    return V.output_name(j).select("job_id", "output_name")


STORED = f"""{FILES}, stored AS (SELECT job_id, CASE WHEN doc_id % 31 = 0 THEN '..' WHEN doc_id % 37 = 0 THEN 'a/b' WHEN job_id % 3 = 0 THEN ord || name ELSE name END AS name FROM files)"""


@query(
    "v16_safe_name_filter",
    f"""WITH {STORED}, p AS (SELECT job_id, name, count(*) AS n FROM stored GROUP BY ALL),
g AS (SELECT job_id, sum(n)::BIGINT AS n_files, sum(CASE WHEN name IN ('', '.', '..') OR contains(name, '/') THEN n ELSE 0 END)::BIGINT AS n_unsafe, max(n) AS most FROM p GROUP BY job_id)
SELECT job_id, n_files, n_unsafe, CASE WHEN n_files > 256 THEN 'too_many' WHEN most > 1 THEN 'duplicate' WHEN n_unsafe > 0 THEN 'unsafe' ELSE 'ok' END AS verdict FROM g""",
)
def v16(spark, sf):
    name = (
        F.when(F.col("doc_id") % 31 == 0, F.lit(".."))
        .when(F.col("doc_id") % 37 == 0, F.lit("a/b"))
        .when(F.col("job_id") % 3 == 0, F.concat(F.col("ord").cast("string"), "name"))
        .otherwise(F.col("name"))
    )
    return V.safe_name_filter(X.files(spark, sf).select("job_id", name.alias("name")))


@query(
    "v17_infer_route",
    f"""WITH {_routes_sql('native')}, {_accept_sql('native')}, {FILES},
b AS (SELECT (doc_id // 14) * 5 + least(doc_id % 7, 4) AS job_id, lower(regexp_extract(name, '([.][^.]+)$', 1)) AS ext FROM files),
c AS (SELECT DISTINCT job_id, CASE WHEN job_id % 6 = 1 THEN 'pdf' END AS source, CASE WHEN job_id % 4 = 2 THEN 'md' END AS target FROM b),
fit AS (SELECT c.job_id, r.route_no, r.source, r.target FROM c JOIN routes r ON coalesce(c.source, r.source) = r.source AND coalesce(c.target, r.target) = r.target
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.job_id = c.job_id AND NOT EXISTS (SELECT 1 FROM accepts a WHERE a.route_no = r.route_no AND a.ext = b.ext))),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY target <> 'pdf', route_no) AS rn FROM fit)
SELECT c.job_id, k.route_no::BIGINT AS route_no, k.source, k.target FROM c LEFT JOIN k ON k.job_id = c.job_id AND rn = 1""",
)
def v17(spark, sf):
    batch = F.expr("(doc_id div 14) * 5 + least(doc_id % 7, 4)")
    f = X.files(spark, sf).withColumn("job_id", batch).select("job_id", "name")
    free = F.lit(None).cast("string")
    choices = f.select("job_id").distinct().select(
        "job_id",
        F.when(F.col("job_id") % 6 == 1, F.lit("pdf")).otherwise(free).alias("source"),
        F.when(F.col("job_id") % 4 == 2, F.lit("md")).otherwise(free).alias("target"),
    )
    return V.infer_route(f, choices)
