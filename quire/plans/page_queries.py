"""Page operators over the whole ``documents`` and ``conversations`` tables."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import pages as P
from quire.plans import fixtures as X
from quire.plans.fixtures import DOC_PAGES, FILES, TRANSLATIONS
from quire.plans.registry import query

SPEC = "1,3-4,-2,9-"

# Which pages the lenient spec 1,3-4,-2,9- selects, written out for SQL.
# An open end below its start swaps, so 9- picks the last page of a shorter document.
SELECTED = "(page_no <= 4 OR page_no >= 9 OR (n_pages < 9 AND page_no = n_pages))"


def _counts(spark, sf):
    """One row per document with its page count: no explode needed."""
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_pages"))


COUNTS = "counts AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_pages FROM documents)"


@query(
    "flagship_select_preview_assemble",
    f"""WITH {DOC_PAGES},
sel AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS sel_no FROM doc_pages WHERE {SELECTED}),
sec AS (SELECT doc_id, page_no, '## Page ' || page_no || chr(10) || chr(10) || trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS s
        FROM sel WHERE sel_no <= 8 AND trim(text, ' ' || chr(9) || chr(13) || chr(10)) <> '')
SELECT d.doc_id, coalesce(string_agg(s, chr(10) || chr(10) ORDER BY page_no), '') || chr(10) AS ocr_text
FROM (SELECT DISTINCT doc_id FROM sel) d LEFT JOIN sec USING (doc_id) GROUP BY d.doc_id""",
)
def flagship(spark, sf):
    sel = P.select_pages(X.doc_pages(spark, sf), SPEC)
    return P.assemble_ocr_text(P.preview_pages(sel, 8, number="sel_no"))


@query(
    "p1_explode_pages",
    f"WITH {DOC_PAGES} SELECT doc_id, page_no, n_pages, text, rotation, x0, y0, x1, y1 FROM doc_pages",
)
def p1(spark, sf):
    return X.doc_pages(spark, sf)


@query("p2_page_count", f"WITH {DOC_PAGES} SELECT doc_id, count(*) AS page_count FROM doc_pages GROUP BY doc_id")
def p2(spark, sf):
    return P.page_count(X.doc_pages(spark, sf))


@query(
    "p3_select_pages",
    f"""WITH {DOC_PAGES},
parts AS (SELECT trim(unnest(string_split('{SPEC}', ',')), ' ') AS p),
r AS (SELECT CASE WHEN NOT contains(p, '-') THEN p::BIGINT WHEN split_part(p, '-', 1) = '' THEN 1 ELSE split_part(p, '-', 1)::BIGINT END AS lo,
             CASE WHEN NOT contains(p, '-') THEN p::BIGINT WHEN split_part(p, '-', 2) = '' THEN NULL ELSE split_part(p, '-', 2)::BIGINT END AS hi FROM parts),
sel AS (SELECT * FROM doc_pages d WHERE EXISTS (
  SELECT 1 FROM r WHERE d.page_no BETWEEN least(r.lo, coalesce(r.hi, d.n_pages)) AND greatest(r.lo, coalesce(r.hi, d.n_pages))))
SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS sel_no, text FROM sel""",
)
def p3(spark, sf):
    return P.select_pages(X.doc_pages(spark, sf), SPEC).select("doc_id", "page_no", "sel_no", "text")


# One strict spec per document, by doc_id: good, reversed, empty part, outside, blank.
def _strict_specs(spark, sf):
    d = _counts(spark, sf)
    n = F.col("n_pages").cast("string")
    k = F.col("doc_id") % 7
    spec = (
        F.when(k == 0, F.lit("1"))
        .when(k == 1, F.concat(F.lit(" 1-"), n, F.lit(" ,1")))
        .when(k == 2, F.lit("3-1"))
        .when(k == 3, F.lit("1,,1"))
        .when(k == 4, F.concat(F.lit("1,"), (F.col("n_pages") + 1).cast("string")))
        .when(k == 5, F.lit("  "))
        .otherwise(F.concat(n, F.lit(",1-"), n))
    )
    return d.withColumn("spec", spec)


STRICT_SPECS = f"""{COUNTS},
specs AS (SELECT doc_id, n_pages, CASE doc_id % 7 WHEN 0 THEN '1' WHEN 1 THEN ' 1-' || n_pages || ' ,1' WHEN 2 THEN '3-1'
  WHEN 3 THEN '1,,1' WHEN 4 THEN '1,' || (n_pages + 1) WHEN 5 THEN '  ' ELSE n_pages || ',1-' || n_pages END AS spec FROM counts)"""


@query(
    "p4_page_indexes",
    f"""WITH {STRICT_SPECS},
parts AS (SELECT doc_id, n_pages, unnest(string_split(trim(spec, ' '), ',')) AS p, unnest(range(0, len(string_split(trim(spec, ' '), ',')))) AS i
          FROM specs WHERE trim(spec, ' ') <> ''),
pr AS (SELECT doc_id, n_pages, i, regexp_matches(trim(p, ' '), '^[+]?[0-9]+(-[+]?[0-9]+)?$') AS shape,
              try_cast(split_part(trim(p, ' '), '-', 1) AS BIGINT) AS lo,
              try_cast(split_part(trim(p, ' '), '-', -1) AS BIGINT) AS hi FROM parts),
err AS (SELECT doc_id, CASE WHEN bool_or(NOT shape OR coalesce(lo > hi, TRUE)) THEN 'syntax'
                            WHEN bool_or(lo < 1 OR hi > n_pages) THEN 'out_of_range' END AS error FROM pr GROUP BY doc_id),
ex AS (SELECT doc_id, i, unnest(range(lo, hi + 1)) AS pg FROM pr JOIN err USING (doc_id) WHERE error IS NULL),
lst AS (SELECT doc_id, string_agg((pg - 1)::VARCHAR, ',' ORDER BY i, pg) AS idx FROM ex GROUP BY doc_id)
SELECT s.doc_id, e.error, CASE WHEN e.error IS NULL THEN coalesce(l.idx, '') END AS indexes
FROM specs s LEFT JOIN err e USING (doc_id) LEFT JOIN lst l USING (doc_id)""",
)
def p4(spark, sf):
    out = P.page_indexes(_strict_specs(spark, sf), F.col("spec"))
    return out.select("doc_id", "error", F.array_join(F.col("indexes").cast("array<string>"), ",").alias("indexes"))


ORDER = "3-1,5-,1"


@query(
    "p5_reorder_pages",
    f"""WITH {DOC_PAGES},
one AS (SELECT DISTINCT doc_id, n_pages FROM doc_pages),
runs AS (SELECT doc_id, 1 AS k, least(3, n_pages) AS a, 1 AS b FROM one
  UNION ALL SELECT doc_id, 2, least(5, n_pages), n_pages FROM one
  UNION ALL SELECT doc_id, 3, 1, 1 FROM one),
hit AS (SELECT p.doc_id, r.k, p.page_no, p.text, abs(p.page_no - r.a) AS step FROM doc_pages p JOIN runs r
        ON r.doc_id = p.doc_id AND p.page_no BETWEEN least(r.a, r.b) AND greatest(r.a, r.b)),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, step) AS new_no,
               count(*) OVER (PARTITION BY doc_id) AS total FROM hit)
SELECT doc_id, page_no AS from_page, new_no AS page_no, total AS n_pages, text FROM num""",
)
def p5(spark, sf):
    return P.reorder_pages(X.doc_pages(spark, sf), ORDER).select("doc_id", "from_page", "page_no", "n_pages", "text")


@query(
    "p6_reorder_check",
    f"""WITH {COUNTS},
specs AS (SELECT doc_id, n_pages, CASE doc_id % 4 WHEN 0 THEN '1-' || n_pages WHEN 1 THEN n_pages || ',1-' || (n_pages - 1)
   WHEN 2 THEN '1-' || n_pages || ',1' ELSE '' END AS spec FROM counts),
v AS (SELECT *, doc_id % 4 AS k FROM specs)
SELECT doc_id, n_pages, CASE WHEN k = 3 THEN 'unchanged' WHEN k = 0 THEN 'ok' WHEN k = 2 THEN 'not_a_permutation'
  WHEN n_pages = 1 THEN 'syntax' ELSE 'ok' END AS verdict FROM v""",
)
def p6(spark, sf):
    n = F.col("n_pages").cast("string")
    k = F.col("doc_id") % 4
    spec = (
        F.when(k == 0, F.concat(F.lit("1-"), n))
        .when(k == 1, F.concat(n, F.lit(",1-"), (F.col("n_pages") - 1).cast("string")))
        .when(k == 2, F.concat(F.lit("1-"), n, F.lit(",1")))
        .otherwise("")
    )
    docs = _counts(spark, sf).withColumn("spec", spec)
    return P.reorder_check(docs, F.col("spec")).select("doc_id", "n_pages", "verdict")


DELETE = "2,4-6"
KEPT = "NOT (page_no = 2 OR page_no BETWEEN 4 AND 6)"


@query(
    "p7_delete_pages",
    f"""WITH {DOC_PAGES}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_no,
       count(*) OVER (PARTITION BY doc_id) AS n_pages, text FROM doc_pages WHERE {KEPT}""",
)
def p7(spark, sf):
    return P.delete_pages(X.doc_pages(spark, sf), DELETE).select("doc_id", "page_no", "n_pages", "text")


@query(
    "p7_delete_check",
    f"""WITH {DOC_PAGES}
SELECT doc_id, count(*) FILTER (WHERE page_no > 3) AS pages_left, count(*) FILTER (WHERE page_no > 3) = 0 AS refused
FROM doc_pages GROUP BY doc_id""",
)
def p7_check(spark, sf):
    return P.delete_check(_counts(spark, sf), "-3").select("doc_id", "pages_left", "refused")


@query(
    "p8_rotate_pages",
    f"""WITH {DOC_PAGES}, t AS (SELECT doc_id, page_no, CASE WHEN page_no >= 2 OR n_pages = 1 THEN 270 ELSE 0 END AS web FROM doc_pages)
SELECT doc_id, page_no, web AS web_rotation,
       CASE WHEN page_no BETWEEN 1 AND 3 THEN ((web + 180) % 360 + 360) % 360 ELSE web END AS native_rotation FROM t""",
)
def p8(spark, sf):
    web = P.rotate_pages(X.doc_pages(spark, sf), "2-", -90, "web").withColumn("web_rotation", F.col("rotation"))
    return P.rotate_pages(web, "1-3", 180, "native").select(
        "doc_id", "page_no", "web_rotation", F.col("rotation").alias("native_rotation")
    )


@query(
    "p9_crop_pages",
    f"""WITH {DOC_PAGES}
SELECT doc_id, page_no,
       CASE WHEN page_no = 3 THEN 20.0 WHEN page_no <= 2 THEN 10.0 ELSE 0.0 END::DOUBLE AS x0,
       CASE WHEN page_no = 3 THEN 30.0 WHEN page_no <= 2 THEN 20.0 ELSE 0.0 END::DOUBLE AS y0,
       CASE WHEN page_no = 3 THEN 580.0 WHEN page_no <= 2 THEN 300.0 ELSE 595.0 END::DOUBLE AS x1,
       CASE WHEN page_no = 3 THEN 800.0 WHEN page_no <= 2 THEN 400.0 ELSE 842.0 END::DOUBLE AS y1,
       page_no = 2 AS crop_error
FROM doc_pages""",
)
def p9(spark, sf):
    web = P.crop_pages(X.doc_pages(spark, sf), "1-2", (10, 20, 300, 400), "web")
    return P.crop_pages(web, "2-3", (20, 30, 580, 800), "native").select(
        "doc_id", "page_no", "x0", "y0", "x1", "y1", "crop_error"
    )


@query(
    "p10_stamp_watermark",
    f"""WITH {DOC_PAGES}
SELECT doc_id, page_no, 595.0::DOUBLE * 0.18::DOUBLE AS ann_x, 842.0::DOUBLE * 0.52::DOUBLE AS ann_y, NULL::DOUBLE AS ann_w, NULL::DOUBLE AS ann_h,
       32 AS ann_font, 25 AS ann_angle, 'DRAFT' AS ann_text, 'web' AS profile FROM doc_pages
UNION ALL
SELECT doc_id, page_no, 595.0::DOUBLE * 0.12::DOUBLE, 421.0 - 32.0, 595.0::DOUBLE * 0.76::DOUBLE, 64.0, 30, 0, 'DRAFT', 'native' FROM doc_pages""",
)
def p10(spark, sf):
    pages = X.doc_pages(spark, sf)
    web = P.stamp_watermark(pages, "DRAFT", "web").withColumn("profile", F.lit("web"))
    return web.unionByName(P.stamp_watermark(pages, " DRAFT ", "native").withColumn("profile", F.lit("native")))


@query(
    "p11_replace_text",
    f"""WITH {DOC_PAGES}
SELECT doc_id, page_no, replace(text, 'the', '[X]') AS text,
       (length(text) - length(replace(text, 'the', ''))) // 3 AS hits FROM doc_pages""",
)
def p11(spark, sf):
    return P.replace_text(X.doc_pages(spark, sf), "the", "[X]").select("doc_id", "page_no", "text", "hits")


@query(
    "p11_replace_report",
    f"""WITH {DOC_PAGES}, h AS (SELECT doc_id, (length(text) - length(replace(text, 'tion', ''))) // 4 AS hits FROM doc_pages)
SELECT doc_id, sum(hits)::BIGINT AS hits, max(hits) AS page_max,
       CASE WHEN sum(hits) = 0 THEN 'not_found' WHEN max(hits) > 5000 THEN 'too_many' ELSE 'ok' END AS verdict
FROM h GROUP BY doc_id""",
)
def p11_report(spark, sf):
    return P.replace_report(P.replace_text(X.doc_pages(spark, sf), "tion", "TION"))


@query(
    "p11_replace_selection",
    f"""WITH {DOC_PAGES}, s AS (SELECT *, instr(text, 'the') AS k FROM doc_pages)
SELECT doc_id, page_no, page_no = 2 AND k = 0 AS stale,
       CASE WHEN page_no = 2 AND k > 0 THEN substr(text, 1, k - 1) || '<A>' || substr(text, k + 3) ELSE text END AS text FROM s""",
)
def p11_selection(spark, sf):
    at = F.instr("text", "the")
    return P.replace_selection(X.doc_pages(spark, sf), 2, at, "the", "<A>").select("doc_id", "page_no", "stale", "text")


@query(
    "p12_merge_documents",
    f"""WITH {DOC_PAGES}
SELECT doc_id // 8 AS job_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id % 8, page_no) AS new_page_no,
       doc_id, page_no, text FROM doc_pages""",
)
def p12(spark, sf):
    order = _counts(spark, sf).select(
        F.expr("doc_id div 8").alias("job_id"), (F.col("doc_id") % 8 + 1).alias("ord"), "doc_id", "n_pages"
    )
    return P.merge_documents(X.doc_pages(spark, sf), order)


WEB_EDIT = {
    "reorder_pages": "3-1,5-",
    "delete_pages": "2",
    "rotate_pages": "1",
    "rotate_degrees": "90",
    "crop_pages": "1-2",
    "crop_box": "10,20,300,400",
    "replace_find": "er",
    "replace_with": "ER",
    "watermark": "DRAFT",
}


@query(
    "p13_edit_pages_web",
    f"""WITH {DOC_PAGES},
runs AS (SELECT doc_id, page_no, text, 1 AS k, -page_no AS step FROM doc_pages WHERE page_no <= 3
  UNION ALL SELECT doc_id, page_no, text, 2, page_no FROM doc_pages WHERE page_no >= least(5, n_pages)),
re AS (SELECT doc_id, page_no AS from_page, text, row_number() OVER (PARTITION BY doc_id ORDER BY k, step) AS no FROM runs),
del AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS page_no FROM re WHERE no <> 2)
SELECT doc_id, page_no, replace(text, 'er', 'ER') AS text, (length(text) - length(replace(text, 'er', ''))) // 2 AS hits,
       CASE WHEN page_no = 1 THEN 90 ELSE 0 END AS rotation,
       CASE WHEN page_no <= 2 THEN 10.0 ELSE 0.0 END::DOUBLE AS x0, 'DRAFT' AS watermark FROM del""",
)
def p13_web(spark, sf):
    return P.edit_pages(X.doc_pages(spark, sf), WEB_EDIT, "web").select(
        "doc_id", "page_no", "text", "hits", "rotation", "x0", "watermark"
    )


NATIVE_EDIT = {
    "delete_pages": "2",
    "rotate_pages": "1",
    "rotate_degrees": "-90",
    "crop_pages": "1",
    "crop_box": "10,20,300,400",
    "replace_find": "er",
    "replace_with": "ER",
    "watermark": "DRAFT",
}


@query(
    "p13_edit_pages_native",
    f"""WITH {DOC_PAGES},
del AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_no FROM doc_pages WHERE page_no <> 2)
SELECT doc_id, page_no, replace(text, 'er', 'ER') AS text, (length(text) - length(replace(text, 'er', ''))) // 2 AS hits,
       CASE WHEN page_no = 1 THEN 270 ELSE 0 END AS rotation,
       CASE WHEN page_no = 1 THEN 10.0 ELSE 0.0 END::DOUBLE AS x0, 'DRAFT' AS watermark FROM del""",
)
def p13_native(spark, sf):
    return P.edit_pages(X.doc_pages(spark, sf), NATIVE_EDIT, "native").select(
        "doc_id", "page_no", "text", "hits", "rotation", "x0", "watermark"
    )


@query(
    "p14_preview_pages",
    f"""WITH {DOC_PAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS rn FROM doc_pages)
SELECT doc_id, page_no, text FROM r WHERE rn <= 12""",
)
def p14(spark, sf):
    return P.preview_pages(X.doc_pages(spark, sf), 12).select("doc_id", "page_no", "text")


@query(
    "p15_natural_order",
    """WITH n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'cover.png' WHEN doc_id % 10 = 7 THEN 'page-x' || doc_id || '.png'
                 ELSE 'page-' || doc_id || '.png' END AS name FROM documents)
SELECT name, CASE WHEN doc_id % 10 IN (3, 7) THEN 0 ELSE doc_id END AS page_key FROM n""",
)
def p15(spark, sf):
    k = F.col("doc_id") % 10
    name = (
        F.when(k == 3, F.lit("cover.png"))
        .when(k == 7, F.concat(F.lit("page-x"), F.col("doc_id").cast("string"), F.lit(".png")))
        .otherwise(F.concat(F.lit("page-"), F.col("doc_id").cast("string"), F.lit(".png")))
    )
    d = X.table(spark, sf, "documents").select(name.alias("name"))
    return P.natural_order(d).orderBy("page_key", "name")


def _job_pages(spark, sf):
    return (
        X.doc_pages(spark, sf)
        .withColumn("job_id", F.expr("doc_id div 8"))
        .withColumn("ord", F.col("doc_id") % 8 + 1)
    )


WS = "' ' || chr(9) || chr(13) || chr(10)"


@query(
    "p16_assemble_markdown",
    f"""WITH {DOC_PAGES}
SELECT doc_id // 8 AS job_id, doc_id % 8 + 1 AS ord, doc_id,
       CASE WHEN doc_id % 8 = 0 THEN '' ELSE chr(10) || chr(10) END ||
       string_agg(trim(text, {WS}), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_no) AS markdown
FROM doc_pages GROUP BY doc_id""",
)
def p16(spark, sf):
    return P.assemble_markdown(_job_pages(spark, sf))


@query(
    "p16_assemble_sections",
    f"""WITH {FILES}, n AS (SELECT job_id, count(*) AS n_docs FROM files GROUP BY job_id)
SELECT f.job_id, f.ord, CASE WHEN ord = 1 THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END ||
  CASE WHEN n_docs > 1 THEN '# ' || regexp_replace(name, '[.][^.]+$', '') || chr(10) || chr(10) ELSE '' END || d.text AS markdown
FROM files f JOIN n USING (job_id) JOIN documents d USING (doc_id)""",
)
def p16_sections(spark, sf):
    f = X.files(spark, sf)
    n = f.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_docs"))
    d = X.table(spark, sf, "documents").select("doc_id", F.col("text").alias("markdown"))
    return P.assemble_sections(f.join(n, "job_id").join(d, "doc_id"))


@query(
    "p17_assemble_ocr_text",
    f"""WITH {DOC_PAGES}, c AS (SELECT doc_id, page_no, CASE WHEN page_no % 3 = 0 THEN ' ' ELSE text END AS text FROM doc_pages),
s AS (SELECT doc_id, string_agg(CASE WHEN trim(text, {WS}) <> '' THEN '## Page ' || page_no || chr(10) || chr(10) || trim(text, {WS}) END,
             chr(10) || chr(10) ORDER BY page_no) AS t FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(t, '') || chr(10) AS ocr_text FROM s""",
)
def p17(spark, sf):
    pages = X.doc_pages(spark, sf).withColumn(
        "text", F.when(F.col("page_no") % 3 == 0, F.lit(" ")).otherwise(F.col("text"))
    )
    return P.assemble_ocr_text(pages, "web")


@query(
    "p17_assemble_ocr_text_native",
    f"""WITH {DOC_PAGES} SELECT doc_id, string_agg(CASE WHEN page_no % 3 = 0 THEN '' ELSE text END, chr(10) || chr(10) ORDER BY page_no) AS ocr_text
FROM doc_pages GROUP BY doc_id""",
)
def p17_native(spark, sf):
    pages = X.doc_pages(spark, sf).withColumn(
        "text", F.when(F.col("page_no") % 3 == 0, F.lit("")).otherwise(F.col("text"))
    )
    return P.assemble_ocr_text(pages, "native")


@query(
    "p18_fallback_text",
    f"""WITH {DOC_PAGES},
own AS (SELECT doc_id, page_no, trim(CASE WHEN page_no % 5 = 0 THEN '  ' ELSE text END, {WS}) AS t FROM doc_pages),
ocr AS (SELECT doc_id, page_no, 'OCR ' || text AS o FROM doc_pages WHERE page_no % 10 = 0)
SELECT doc_id, page_no, CASE WHEN t <> '' THEN t ELSE coalesce(o, '') END AS text,
       CASE WHEN t <> '' THEN 'layer' ELSE 'ocr' END AS origin
FROM own LEFT JOIN ocr USING (doc_id, page_no)""",
)
def p18(spark, sf):
    pages = X.doc_pages(spark, sf)
    own = pages.withColumn("text", F.when(F.col("page_no") % 5 == 0, F.lit("  ")).otherwise(F.col("text")))
    ocr = pages.filter("page_no % 10 = 0").withColumn("text", F.concat(F.lit("OCR "), "text"))
    return P.fallback_text(own, ocr)


@query(
    "p19_interleave_bilingual",
    f"""WITH {TRANSLATIONS},
u AS (SELECT conv_id, page_no, 'translation' AS side, 0 AS k, translated_text AS text FROM translations WHERE page_no <= 2 OR page_no = 4
  UNION ALL SELECT conv_id, page_no, 'original', 1, source_text FROM translations)
SELECT conv_id, page_no, side, row_number() OVER (PARTITION BY conv_id ORDER BY page_no, k) AS new_page_no, text FROM u""",
)
def p19(spark, sf):
    return P.interleave_bilingual(X.translations(spark, sf), "1-2,4")


def _sides(spark, sf):
    """Every source turn, and the translated turns (one conversation in three
    gets one extra page)."""
    t = X.translations(spark, sf)
    a = t.select(F.col("conv_id").alias("doc_id"), "page_no", F.col("source_text").alias("text"))
    b = t.filter("translated_text is not null").select(
        F.col("conv_id").alias("doc_id"), "page_no", F.col("translated_text").alias("text")
    )
    extra = t.filter("page_no = 1 and conv_id % 3 = 0").select(
        F.col("conv_id").alias("doc_id"), F.lit(1000).cast("bigint").alias("page_no"), F.lit("notes").alias("text")
    )
    return a, b.unionByName(extra)


SIDES = f"""{TRANSLATIONS},
a AS (SELECT conv_id AS doc_id, page_no, source_text AS text FROM translations),
b AS (SELECT conv_id AS doc_id, page_no, translated_text AS text FROM translations WHERE translated_text IS NOT NULL
      UNION ALL SELECT conv_id, 1000, 'notes' FROM translations WHERE page_no = 1 AND conv_id % 3 = 0)"""


@query(
    "p20_pair_bilingual",
    f"""WITH {SIDES},
ca AS (SELECT doc_id, count(*) AS n_o FROM a GROUP BY doc_id), cb AS (SELECT doc_id, count(*) AS n_t FROM b GROUP BY doc_id),
ok AS (SELECT coalesce(ca.doc_id, cb.doc_id) AS doc_id, coalesce(n_o, 0) > 0 AND (coalesce(n_o, 0) = coalesce(n_t, 0)
        OR (coalesce(n_o, 0) < coalesce(n_t, 0) AND coalesce(ca.doc_id, cb.doc_id) % 2 = 0)) AS ok FROM ca FULL JOIN cb ON ca.doc_id = cb.doc_id)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page_no, b.page_no) AS page_no,
       CASE WHEN NOT ok THEN 'rejected' WHEN a.text IS NULL THEN 'appended' ELSE 'paired' END AS pair_kind,
       a.text AS original_text, b.text AS translated_text
FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.page_no = b.page_no JOIN ok ON ok.doc_id = coalesce(a.doc_id, b.doc_id)""",
)
def p20(spark, sf):
    a, b = _sides(spark, sf)
    marked = X.table(spark, sf, "conversations").filter("conv_id % 2 = 0").select(
        F.col("conv_id").alias("doc_id")
    ).distinct()
    return P.pair_pages(a, b, marked)


@query(
    "p21_page_count_diff",
    f"""WITH {SIDES},
ca AS (SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id), cb AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id)
SELECT coalesce(ca.doc_id, cb.doc_id) AS doc_id, coalesce(ca.n, 0) AS n_a, coalesce(cb.n, 0) AS n_b,
       coalesce(ca.n = cb.n AND ca.n > 0, FALSE) AS comparable FROM ca FULL JOIN cb ON ca.doc_id = cb.doc_id""",
)
def p21(spark, sf):
    return P.compare_counts(*_sides(spark, sf))


SEARCH_TERM = "Éré"
MATCHES = f"""{DOC_PAGES},
f AS (SELECT doc_id, page_no, string_split(strip_accents(lower(text)), 'ere') AS parts FROM doc_pages),
e AS (SELECT doc_id, page_no, parts, unnest(range(1, len(parts))) AS i FROM f WHERE len(parts) > 1),
m AS (SELECT doc_id, page_no, 1 + (i - 1) * 3 + length(array_to_string(parts[1:i], '')) AS char_pos FROM e),
r AS (SELECT doc_id, page_no, char_pos, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, char_pos) AS match_no FROM m),
matches AS (SELECT *, match_no <= 2000 AS shown FROM r)"""


@query("p22_search", f"WITH {MATCHES} SELECT doc_id, page_no, char_pos, match_no, shown FROM matches")
def p22(spark, sf):
    return P.search(X.doc_pages(spark, sf), SEARCH_TERM)


@query(
    "p23_match_neighbours",
    f"""WITH {MATCHES}
SELECT doc_id, match_no,
  coalesce(lead(match_no) OVER w, first_value(match_no) OVER w) AS next_no,
  coalesce(lag(match_no) OVER w, last_value(match_no) OVER (PARTITION BY doc_id ORDER BY match_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_no
FROM matches WINDOW w AS (PARTITION BY doc_id ORDER BY match_no)""",
)
def p23(spark, sf):
    return P.match_neighbours(P.search(X.doc_pages(spark, sf), SEARCH_TERM))


GEOMETRY = f"""{DOC_PAGES},
g0 AS (SELECT doc_id, page_no, CASE WHEN page_no % 2 = 0 THEN 842.0 ELSE 595.0 END::DOUBLE AS width,
              CASE WHEN page_no % 2 = 0 THEN 595.0 ELSE 842.0 END::DOUBLE AS height FROM doc_pages),
g AS (SELECT *, width * 2 + 16 AS sheet_width, least(2400.0::DOUBLE / greatest(width, height), 4.0::DOUBLE) AS scale FROM g0),
geo AS (SELECT doc_id, page_no, width, height, sheet_width, scale, ceil(width * scale)::BIGINT AS px_w, ceil(height * scale)::BIGINT AS px_h, FALSE AS invalid FROM g)"""


def _turned(spark, sf):
    return X.doc_pages(spark, sf).withColumn("rotation", F.when(F.col("page_no") % 2 == 0, F.lit(90)).otherwise(F.lit(0)))


@query("p24_page_geometry", f"WITH {GEOMETRY} SELECT * FROM geo")
def p24(spark, sf):
    return P.page_geometry(_turned(spark, sf))


@query(
    "p24_pixel_totals",
    f"WITH {GEOMETRY} SELECT doc_id, sum(px_w * px_h)::BIGINT AS pixels, count(*) FILTER (WHERE invalid) AS invalid_pages FROM geo GROUP BY doc_id",
)
def p24_totals(spark, sf):
    return P.pixel_totals(P.page_geometry(_turned(spark, sf)))


@query(
    "p25_unchanged_output",
    f"""WITH o AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '  ') ELSE upper(text) END AS out FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS a, trim(regexp_replace(out, '[ \t\r\n]+', ' ', 'g'), ' ') AS b FROM o)
SELECT doc_id, a = b AS unchanged, length(a) AS n_chars FROM n""",
)
def p25(spark, sf):
    pages = X.doc_pages(spark, sf)
    k = F.col("doc_id") % 3
    out = pages.withColumn(
        "text",
        F.when(k == 0, F.col("text"))
        .when(k == 1, F.replace(F.col("text"), F.lit(" "), F.lit("  ")))
        .otherwise(F.upper("text")),
    )
    return P.unchanged_output(pages, out)
