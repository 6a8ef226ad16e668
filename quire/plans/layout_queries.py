"""Layout operators on lines and regions cut from ``documents``."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import layout as L
from quire.plans import fixtures as X
from quire.plans.fixtures import LAYOUT_LINES, REGIONS
from quire.plans.registry import query

WS = "' ' || chr(9) || chr(13) || chr(10)"


def _lines(spark, sf):
    """Raw lines with runs: a third of the text in another font, boldness and colour of
    their own; pages of every third document are narrow."""
    third = (F.length("text") / 3).cast("int")
    run = lambda font, size, bold, color: F.struct(font.alias("font"), size.alias("len"), bold.alias("bold"), F.lit(color).alias("color"))
    first = F.when(F.col("line") % 3 == 0, run(F.lit(9.0), third, F.col("line") % 46 == 45, "red")).otherwise(run(F.lit(9.0), third, F.col("line") % 46 == 45, "blue"))
    runs = F.array(first, run(F.col("font_size"), F.length("text") - third * 2, F.col("bold"), "grey"), run(F.lit(8.0), third, F.lit(True), "grey"))
    marked = F.when(F.col("line") % 6 == 5, F.concat(F.lit(" ￼"), F.col("text"), F.lit("\t"))).otherwise(F.col("text"))
    narrow = F.when(F.col("doc_id") % 3 == 0, F.lit(310.0)).otherwise(F.col("px1"))
    return X.layout_lines(spark, sf).withColumn("runs", runs).withColumn("text", marked).withColumn("px1", narrow)


CLEAN = f"""{LAYOUT_LINES},
clean AS (SELECT doc_id, page_index, line, trim(replace(CASE WHEN line % 6 = 5 THEN ' ￼' || text || chr(9) ELSE text END, '￼', ''), {WS}) AS text,
   greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, CASE WHEN doc_id % 3 = 0 THEN 310 ELSE 595 END) - greatest(x, 0) AS w, least(y + h, 842) - greatest(y, 0) AS h,
   CASE WHEN length(text) // 3 >= length(text) - 2 * (length(text) // 3) THEN 9.0::DOUBLE ELSE font_size END AS font_size,
   CASE WHEN length(text) // 3 >= length(text) - 2 * (length(text) // 3) THEN line % 46 = 45 ELSE bold END AS bold,
   CASE WHEN line % 3 = 0 THEN 'red' ELSE 'blue' END AS color, 0.0::DOUBLE AS px0, CASE WHEN doc_id % 3 = 0 THEN 310.0::DOUBLE ELSE 595.0::DOUBLE END AS px1 FROM layout_lines),
cl AS (SELECT *, upper(text) IN ('ARTICLE IN PRESS', 'ACCEPTED MANUSCRIPT') OR h > font_size * 2.5 AS preserve FROM clean WHERE text <> '' AND w >= 2 AND h >= 2)"""


def _clean(spark, sf):
    return L.preserve_flag(L.clean_lines(_lines(spark, sf)))


@query("r1_clean_lines", f"WITH {CLEAN} SELECT doc_id, page_index, line, text, x, y, w, h, font_size, bold, color FROM cl")
def r1(spark, sf):
    return L.clean_lines(_lines(spark, sf)).select("doc_id", "page_index", "line", "text", "x", "y", "w", "h", "font_size", "bold", "color")


@query("r2_preserve_flag", f"WITH {CLEAN} SELECT doc_id, line, preserve FROM cl")
def r2(spark, sf):
    return _clean(spark, sf).select("doc_id", "line", "preserve")


JOINED = f"""{CLEAN},
idx AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY line) AS i FROM cl WHERE NOT preserve),
st AS (SELECT doc_id, page_index, i, 1 AS g, line, text, x, y, w, h, font_size, bold, color, px0, px1 FROM idx WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.page_index, n.i, CASE WHEN near THEN n.g ELSE n.g + 1 END, CASE WHEN near THEN n.l0 ELSE n.line END,
    CASE WHEN near THEN n.t0 || ' ' || n.text ELSE n.text END,
    CASE WHEN near THEN least(x0, x) ELSE x END, CASE WHEN near THEN least(y0, y) ELSE y END,
    CASE WHEN near THEN greatest(x0 + w0, x + w) - least(x0, x) ELSE w END, CASE WHEN near THEN greatest(y0 + h0, y + h) - least(y0, y) ELSE h END,
    CASE WHEN near THEN greatest(f0, font_size) ELSE font_size END, CASE WHEN near THEN b0 ELSE bold END,
    CASE WHEN near THEN c0 ELSE color END, px0, px1
  FROM (SELECT c.*, s.g, s.line AS l0, s.text AS t0, s.x AS x0, s.y AS y0, s.w AS w0, s.h AS h0, s.font_size AS f0, s.bold AS b0, s.color AS c0,
          abs(s.y - c.y) <= least(s.h, c.h) * 0.35 AND c.x - (s.x + s.w) >= -1 AND c.x - (s.x + s.w) <= greatest(s.font_size, c.font_size) * 0.65 AS near
        FROM st s JOIN idx c ON c.doc_id = s.doc_id AND c.page_index = s.page_index AND c.i = s.i + 1) n),
last AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, g ORDER BY i DESC) AS rn FROM st),
joined AS (SELECT doc_id, page_index, line, text, x, y, w, h, font_size, bold, color, px0, px1, FALSE AS preserve FROM last WHERE rn = 1
  UNION ALL SELECT doc_id, page_index, line, text, x, y, w, h, font_size, bold, color, px0, px1, TRUE FROM cl WHERE preserve)"""


@query("r3_join_runs", f"WITH RECURSIVE {JOINED} SELECT * FROM joined")
def r3(spark, sf):
    return L.join_runs(_clean(spark, sf))


GROUPED = f"""{JOINED},
lg AS (SELECT *, lag(x) OVER p AS ax, lag(y) OVER p AS ay, lag(w) OVER p AS aw, lag(h) OVER p AS ah, lag(font_size) OVER p AS af, lag(bold) OVER p AS ab
       FROM joined WINDOW p AS (PARTITION BY doc_id, page_index ORDER BY preserve, line)),
mg AS (SELECT *, NOT preserve AND coalesce(CASE WHEN least(aw, w) > 0 THEN greatest(0, least(ax + aw, x + w) - greatest(ax, x)) / least(aw, w) ELSE 0 END >= 0.45
   AND greatest(0, greatest(ay, y) - least(ay + ah, y + h)) <= greatest(3, least(af, font_size) * 1.3) AND abs(af - font_size) <= greatest(0.75, af * 0.12)
   AND ab = bold AND ax + aw >= x + w - af * 2 AND x <= ax + af * 0.8 AND y + h / 2 < ay + ah / 2, FALSE) AS cont FROM lg),
gp AS (SELECT *, sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_index ORDER BY preserve, line ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM mg)"""


@query("r4_group_paragraphs", f"WITH RECURSIVE {GROUPED} SELECT doc_id, page_index, line, group_no FROM gp")
def r4(spark, sf):
    return L.group_paragraphs(L.join_runs(_clean(spark, sf))).select("doc_id", "page_index", "line", "group_no")


@query(
    "r5_paragraph_aggregate",
    f"""WITH RECURSIVE {GROUPED},
a AS (SELECT doc_id, page_index, group_no, min(line) AS line, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h,
   list_sort(list(font_size))[count(*) // 2 + 1] AS font_size, arg_min(bold, line) AS bold, arg_min(color, line) AS color, bool_or(preserve) AS preserve, max(px1) AS px1, sum(length(text)) AS n,
   max(x + w / 2) AS m1, min(x + w / 2) AS m0, string_agg(text, chr(10) ORDER BY line) AS text FROM gp GROUP BY ALL)
SELECT doc_id, page_index, group_no, line, x, y, w, h, font_size, bold, color, preserve,
  (n <= 200 OR font_size >= 16) AND abs(x + w / 2 - px1 / 2) < px1 * 0.08 AND m1 - (x + w / 2) < font_size AND x + w / 2 - m0 < font_size AS centered, text FROM a""",
)
def r5(spark, sf):
    return L.paragraph_aggregate(L.group_paragraphs(L.join_runs(_clean(spark, sf))))


@query("r6_region_ids", f"WITH {REGIONS} SELECT doc_id, line, region_id FROM regions")
def r6(spark, sf):
    return L.region_ids(X.regions(spark, sf).drop("region_id")).select("doc_id", "line", "region_id")


def _observations(spark, sf):
    n = F.col("line")
    obs = X.layout_lines(spark, sf).select(
        "doc_id",
        "page_index",
        "line",
        F.concat(F.lit(" "), "text").alias("text"),
        (n % 7 / 8).alias("nx"),
        (n % 11 / 16).alias("ny"),
        (0.125 + n % 3 / 8).alias("nw"),
        (n % 5 / 64).alias("nh"),
        (n % 8 / 8).alias("confidence"),
    )
    odd = F.col("page_index") % 2 == 1
    v = lambda a, b: F.when(odd, F.lit(float(a))).otherwise(F.lit(float(b)))
    pages = X.layout_lines(spark, sf).select("doc_id", "page_index").distinct().select(
        "doc_id", "page_index",
        v(1684, 1190).alias("image_w"), v(1190, 1684).alias("image_h"),
        v(0, 2).alias("a"), v(-2, 0).alias("b"), v(2, 0).alias("c"), v(0, 2).alias("d"),
        v(0, 0).alias("tx"), v(1190, 0).alias("ty"),
        F.lit(10.0).alias("px0"), F.lit(10.0).alias("py0"), F.lit(585.0).alias("px1"), F.lit(832.0).alias("py1"),
    )
    return obs, pages


@query(
    "r7_ocr_to_page_space",
    f"""WITH {LAYOUT_LINES},
o AS (SELECT doc_id, page_index, line, trim(text, {WS}) AS text, page_index % 2 = 1 AS odd, (line % 7) / 8 AS nx, (line % 11) / 16 AS ny,
        0.125 + (line % 3) / 8 AS nw, (line % 5) / 64 AS nh FROM layout_lines WHERE (line % 8) / 8 >= 0.35 AND trim(text, {WS}) <> ''),
i AS (SELECT *, nx * CASE WHEN odd THEN 1684 ELSE 1190 END AS ix, ny * CASE WHEN odd THEN 1190 ELSE 1684 END AS iy,
        nw * CASE WHEN odd THEN 1684 ELSE 1190 END AS iw, nh * CASE WHEN odd THEN 1190 ELSE 1684 END AS ih FROM o),
p AS (SELECT doc_id, page_index, line, text, CASE WHEN odd THEN (1190 - (iy + ih)) / 2 ELSE ix / 2 END AS x, CASE WHEN odd THEN ix / 2 ELSE iy / 2 END AS y,
        CASE WHEN odd THEN ih / 2 ELSE iw / 2 END AS w, CASE WHEN odd THEN iw / 2 ELSE ih / 2 END AS h FROM i),
c AS (SELECT doc_id, page_index, line, text, greatest(x, 10) AS x, greatest(y, 10) AS y, least(x + w, 585) - greatest(x, 10) AS w,
        least(y + h, 832) - greatest(y, 10) AS h FROM p)
SELECT doc_id, page_index, line, text, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h,
       greatest(5, least(24, h::DOUBLE * 0.72::DOUBLE))::DOUBLE AS font_size FROM c WHERE w >= 2 AND h >= 2""",
)
def r7(spark, sf):
    obs, pages = _observations(spark, sf)
    return L.ocr_to_page_space(obs, pages)


def _ocr_copy(spark, sf):
    """A recognised copy of every region, shifted and with altered text."""
    n = F.col("line")
    text = (
        F.when(n % 3 == 0, F.lower("text"))
        .when(n % 3 == 1, F.concat(F.col("text"), F.lit(" extra words")))
        .otherwise(F.reverse("text"))
    )
    return X.regions(spark, sf).select(
        "doc_id", "region_id", "page_index", "line", (F.col("x") + n % 4 * 40).alias("x"), "y", "w", "h", text.alias("text")
    )


OCR_COPY = f"""{REGIONS},
nat AS (SELECT *, line % 5 = 4 AS keep FROM regions),
ocr AS (SELECT doc_id, region_id, page_index, line, x + (line % 4) * 40 AS x, y, w, h,
  CASE line % 3 WHEN 0 THEN lower(text) WHEN 1 THEN text || ' extra words' ELSE reverse(text) END AS text FROM regions)"""

OVERLAP = """CASE WHEN least({a}.w * {a}.h, {b}.w * {b}.h) > 0 THEN greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))
  * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) / least({a}.w * {a}.h, {b}.w * {b}.h) ELSE 0 END"""
FOLD = "regexp_replace(replace(strip_accents(lower({c})), 'ß', 'ss'), '[\\s\\p{{Z}}\\p{{P}}]', '', 'g')"
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda w: w <> ''))"


@query(
    "r8_drop_native_duplicates",
    f"""WITH {OCR_COPY},
o AS (SELECT *, {FOLD.format(c='text')} AS ft, {WORDS.format(c='text')} AS ws FROM ocr),
n AS (SELECT *, {FOLD.format(c='text')} AS ft, {WORDS.format(c='text')} AS ws FROM nat),
m AS (SELECT o.doc_id, o.region_id, n.keep, {OVERLAP.format(a='o', b='n')} AS r, contains(n.ft, o.ft) AS inside,
        len(o.ws) AS nw, len(list_intersect(o.ws, n.ws)) AS shared FROM o JOIN n ON n.doc_id = o.doc_id AND n.page_index = o.page_index),
d AS (SELECT DISTINCT doc_id, region_id FROM m WHERE CASE WHEN keep THEN r >= 0.45 AND inside
   ELSE r >= 0.8 OR (r >= 0.45 AND inside) OR (r >= 0.65 AND nw >= 5 AND shared / nw >= 0.85) END)
SELECT doc_id, region_id, text FROM ocr WHERE (doc_id, region_id) NOT IN (SELECT (doc_id, region_id) FROM d)""",
)
def r8(spark, sf):
    native = X.regions(spark, sf).withColumn("preserve", F.col("line") % 5 == 4)
    return L.drop_native_duplicates(_ocr_copy(spark, sf), native).select("doc_id", "region_id", "text")


def _crowded(spark, sf):
    """Regions pushed together so that many overlap."""
    n = F.col("line")
    return X.regions(spark, sf).select(
        "doc_id", "page_index", "line", "region_id", (n * 53 % 300).cast("double").alias("x"), (n * 31 % 90).cast("double").alias("y"),
        "w", "h", "text",
    )


@query(
    "r9_greedy_overlap_dedup",
    f"""WITH RECURSIVE {REGIONS},
c AS (SELECT doc_id, page_index, line, region_id, ((line * 53) % 300)::DOUBLE AS x, ((line * 31) % 90)::DOUBLE AS y, w, h FROM regions),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY line) AS i, struct_pack(x := x, y := y, w := w, h := h) AS box FROM c),
s AS (SELECT doc_id, page_index, i, TRUE AS kept, region_id, [box] AS boxes FROM i WHERE i = 1
  UNION ALL SELECT n.doc_id, n.page_index, n.i, NOT n.clash, n.region_id, CASE WHEN n.clash THEN n.boxes ELSE list_append(n.boxes, n.box) END FROM (
    SELECT i.*, s.boxes, coalesce(list_bool_or(list_transform(s.boxes, lambda k: greatest(0, least(k.x + k.w, i.x + i.w) - greatest(k.x, i.x))
       * greatest(0, least(k.y + k.h, i.y + i.h) - greatest(k.y, i.y)) / least(k.w * k.h, i.w * i.h) >= 0.55)), FALSE) AS clash
    FROM s JOIN i ON i.doc_id = s.doc_id AND i.page_index = s.page_index AND i.i = s.i + 1) n)
SELECT doc_id, page_index, region_id FROM s WHERE kept""",
)
def r9(spark, sf):
    return L.greedy_overlap_dedup(_crowded(spark, sf)).select("doc_id", "page_index", "region_id")


@query("r10_fold_text", f"SELECT doc_id, {FOLD.format(c='text')} AS folded FROM documents")
def r10(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.fold_text(F.col("text")).alias("folded"))


@query(
    "r11_region_cap",
    f"WITH {REGIONS} SELECT doc_id, count(*) AS n_regions, 'too_many_regions' AS code FROM regions GROUP BY doc_id HAVING count(*) > 20",
)
def r11(spark, sf):
    return L.region_cap(X.regions(spark, sf), cap=20)


def _typed(spark, sf):
    """Regions with titles, notes, running heads, captions and page numbers, and
    taller boxes in every other document."""
    n, d = F.col("line"), F.col("doc_id")
    text = (
        F.when((n % 12 == 0) & (d % 3 == 0), F.concat(F.lit("Annual Report "), (n * 7).cast("string")))
        .when((n % 12 == 1) & (d % 2 == 0), F.concat(F.lit("Table 1 "), "text"))
        .when((n % 12 == 4) & (d % 4 < 3), F.concat(F.lit("Notes: "), "text"))
        .when((n % 12 == 7) & (d % 5 == 0), F.concat(F.lit("Fig. 2 "), "text"))
        .when((n % 12 == 9) & (d % 5 == 1), F.concat(F.lit("2.1 "), "text"))
        .when((n % 12 == 11) & (d % 5 == 2), F.lit(" 17 "))
        .when((n % 12 == 8) & (d % 5 == 3), F.lower("text"))
        .when(F.lit(True), F.rtrim(F.col("text"), F.lit(".")))
    )
    return (
        X.regions(spark, sf)
        .withColumn("text", text)
        .withColumn("h", F.when(d % 2 == 0, F.lit(90.0)).otherwise(F.lit(60.0)))
        .withColumn("preserve", n % 31 == 30)
        .withColumn("py0", F.lit(0.0))
        .withColumn("py1", F.when(d % 7 == 3, F.lit(640.0)).otherwise(F.lit(800.0)))
    )


TYPED = f"""{REGIONS},
typed AS (SELECT doc_id, region_id, page_index, line, kind, x, y, w, CASE WHEN doc_id % 2 = 0 THEN 90.0::DOUBLE ELSE 60.0::DOUBLE END AS h,
  font_size, bold, centered, line % 31 = 30 AS preserve, CASE WHEN doc_id % 7 = 3 THEN 640.0::DOUBLE ELSE 800.0::DOUBLE END AS py1,
  CASE WHEN line % 12 = 0 AND doc_id % 3 = 0 THEN 'Annual Report ' || (line * 7) WHEN line % 12 = 1 AND doc_id % 2 = 0 THEN 'Table 1 ' || text
   WHEN line % 12 = 4 AND doc_id % 4 < 3 THEN 'Notes: ' || text WHEN line % 12 = 7 AND doc_id % 5 = 0 THEN 'Fig. 2 ' || text
   WHEN line % 12 = 9 AND doc_id % 5 = 1 THEN '2.1 ' || text WHEN line % 12 = 11 AND doc_id % 5 = 2 THEN ' 17 '
   WHEN line % 12 = 8 AND doc_id % 5 = 3 THEN lower(text) ELSE rtrim(text, '.') END AS text FROM regions)"""

NORM = "trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ')"
HEADERS = f"""{TYPED},
banded AS (SELECT *, {NORM} AS norm, (y + h / 2 < py1 * 0.12 OR y + h / 2 > py1 - py1 * 0.12) AND length(text) < 180 AS cand FROM typed),
heads AS (SELECT doc_id, norm, min(page_index) AS first_page, max(page_index) AS last_page FROM banded WHERE cand GROUP BY doc_id, norm HAVING count(DISTINCT page_index) > 1)"""


@query("r12_running_headers", f"WITH {HEADERS} SELECT * FROM heads")
def r12(spark, sf):
    return L.running_headers(_typed(spark, sf))


CHOSEN = """native_pages AS (SELECT doc_id, page_index, bool_or(kind = 'native_text') AS n FROM {src} WHERE NOT preserve GROUP BY ALL),
chosen AS (SELECT t.* FROM {src} t JOIN native_pages p USING (doc_id, page_index) WHERE NOT preserve AND (kind = 'native_text') = p.n)"""


@query("r13_layer_choice", f"WITH {TYPED}, {CHOSEN.format(src='typed')} SELECT doc_id, region_id, kind FROM chosen")
def r13(spark, sf):
    return L.layer_choice(_typed(spark, sf)).select("doc_id", "region_id", "kind")


@query(
    "r14_body_font",
    f"""WITH {TYPED}, g AS (SELECT doc_id, page_index, list_sort(list(font_size) FILTER (WHERE length(text) >= 80)) AS f FROM typed GROUP BY ALL)
SELECT doc_id, page_index, coalesce(f[len(f) // 2 + 1], 0)::DOUBLE AS body_font FROM g""",
)
def r14(spark, sf):
    return L.body_font(_typed(spark, sf))


ZONES = """titles AS (SELECT * FROM {src} WHERE regexp_matches(text, '{title}')),
notes AS (SELECT * FROM {src} WHERE regexp_matches(text, '{note}')),
tn AS (SELECT t.doc_id, t.page_index, t.region_id, t.x AS tx, t.y AS ty, t.w AS tw, t.h AS th, n.x AS nx, n.y AS ny, n.w AS nw, n.h AS nh,
   row_number() OVER (PARTITION BY t.doc_id, t.region_id ORDER BY n.y + n.h DESC, n.x DESC) AS rn
   FROM titles t JOIN notes n ON n.doc_id = t.doc_id AND n.page_index = t.page_index AND n.y + n.h < t.y AND n.x >= t.x - 12),
zones AS (SELECT doc_id, page_index, region_id, least(tx, nx) AS zone_x, least(ty, ny) AS zone_y, greatest(tx + tw, nx + nw) - least(tx, nx) AS zone_w,
   greatest(ty + th, ny + nh) - least(ty, ny) AS zone_h FROM tn WHERE rn = 1)"""


def _zones(src):
    return ZONES.format(src=src, title=L.TABLE_TITLE, note=L.TABLE_NOTE)


@query("r15_table_zones", f"WITH {TYPED}, {_zones('typed')} SELECT * FROM zones")
def r15(spark, sf):
    return L.table_zones(_typed(spark, sf))


BODY = f"""{HEADERS}, {CHOSEN.format(src='banded')}, {_zones('chosen')},
bf AS (SELECT doc_id, page_index, list_sort(list(font_size) FILTER (WHERE length(text) >= 80)) AS f FROM chosen GROUP BY ALL),
flag AS (SELECT c.*, coalesce(f[len(f) // 2 + 1], 0) AS body, regexp_matches(text, '{L.HEADING}') OR bold AS heading,
   EXISTS (SELECT 1 FROM heads k WHERE k.doc_id = c.doc_id AND k.norm = c.norm) AS rep,
   EXISTS (SELECT 1 FROM zones z WHERE z.doc_id = c.doc_id AND z.page_index = c.page_index AND c.x + c.w / 2 >= zone_x AND c.x + c.w / 2 < zone_x + zone_w
           AND c.y + c.h / 2 >= zone_y AND c.y + c.h / 2 < zone_y + zone_h) AS zoned
   FROM chosen c JOIN bf USING (doc_id, page_index)),
body AS (SELECT * FROM flag WHERE y + h / 2 > py1 * 0.05 AND y + h / 2 < py1 - py1 * 0.05 AND NOT (cand AND rep) AND (heading OR font_size >= body * 0.8)
   AND NOT regexp_matches(text, '{L.PAGE_NUMBER}') AND NOT regexp_matches(text, '{L.CAPTION}') AND NOT zoned
   AND (heading OR (length(text) >= 4 AND w >= font_size * 2)))"""


@query("r16_body_filter", f"WITH {BODY} SELECT doc_id, region_id, text FROM body")
def r16(spark, sf):
    return L.body_filter(L.by_document(_typed(spark, sf))).select("doc_id", "region_id", "text")


def _banded(spark, sf):
    """Even pages: a heading over both columns, one region at the foot."""
    n, even = F.col("line") % 12, F.col("page_index") % 2 == 0
    return (
        X.regions(spark, sf)
        .withColumn("w", F.when(even & (n == 0), F.lit(510.0)).otherwise(F.col("w")))
        .withColumn("y", F.when(even & (n == 6), F.lit(100.0)).otherwise(F.col("y")))
    )


# On even pages the heading forces bands, so rows are read across; on odd pages
# the columns are read one after the other.
@query(
    "r17_reading_order",
    f"""WITH {REGIONS}, g AS (SELECT doc_id, page_index, region_id, page_index % 2 = 0 AS even, x, CASE WHEN page_index % 2 = 0 AND line % 12 = 6 THEN 100 ELSE y END AS y FROM regions)
SELECT doc_id, page_index, region_id, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY CASE WHEN even THEN -y ELSE x END, CASE WHEN even THEN x ELSE -y END) - 1 AS pos FROM g""",
)
def r17(spark, sf):
    return L.reading_order(_banded(spark, sf)).select("doc_id", "page_index", "region_id", "pos")


PAIRS = """ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, x, -y) AS seq FROM {src}),
nx AS (SELECT o.*, n.region_id AS n_id, n.page_index AS n_page, n.kind AS n_kind, n.x AS n_x, n.y AS n_y, n.h AS n_h, n.font_size AS n_font, n.bold AS n_bold, n.text AS n_text
   FROM ord o LEFT JOIN ord n ON n.doc_id = o.doc_id AND n.seq = o.seq + 1),
pairs AS (SELECT *, CASE WHEN n_id IS NULL THEN NULL WHEN n_page = page_index + 1 THEN 'page' WHEN n_page = page_index AND x + w <= n_x THEN 'column'
   WHEN n_page = page_index AND abs(x - n_x) <= font_size * 1.5 AND n_y + n_h <= y + 2 AND y - (n_y + n_h) <= font_size * 1.8 THEN 'below' END AS boundary FROM nx)"""


@query("r18_boundary_pairs", f"WITH {TYPED}, {PAIRS.format(src='typed')} SELECT doc_id, region_id, n_id AS next_id, boundary FROM pairs WHERE boundary IS NOT NULL")
def r18(spark, sf):
    pairs = L.boundary_pairs(L.reading_order(L.by_document(_typed(spark, sf))))
    return pairs.filter("boundary is not null").select("doc_id", "region_id", F.col("nxt.region_id").alias("next_id"), "boundary")


def _prose_sql(t, bold):
    return (
        f"NOT {bold} AND length({t}) >= 4 AND regexp_matches({t}, '\\p{{L}}') AND NOT regexp_matches({t}, '{L.HEADING}') "
        f"AND NOT regexp_matches({t}, '{L.NOT_PROSE}')"
    )


def _continues_sql(a, b, a_bold, b_bold, same_kind, fonts):
    closers = L.CLOSERS.replace("'", "''")
    words = ", ".join(f"'{w}'" for w in L.CONNECTIVES)
    bare = f"trim({a}, '{closers}')"
    more = " OR ".join(
        f"length({a}) - length(replace({a}, '{o}', '')) > length({a}) - length(replace({a}, '{c}', ''))" for o, c in ("()", "[]", "（）")
    )
    lower = f"regexp_matches({b}, '^\\p{{Ll}}')"
    cjk = f"regexp_matches({b}, '{L.CJK_START}')"
    return (
        f"({_prose_sql(a, a_bold)} AND {_prose_sql(b, b_bold)} AND {same_kind} AND length({a}) + length({b}) >= 35 AND {fonts} "
        f"AND (({bare} <> '' AND NOT regexp_matches({bare}, '[{L.STOPS}]$')) OR regexp_matches({bare}, '{L.ABBREVIATION}')) "
        f"AND ({lower} OR {cjk} OR regexp_matches({b}, '{L.TECHNICAL}') OR lower(regexp_extract({a}, '(\\S+)$', 1)) IN ({words}) OR {more}) "
        f"AND (least(length({a}), length({b})) >= 12 OR {lower} OR {cjk}) AND NOT starts_with({b}, 'http') AND NOT starts_with({b}, 'doi:'))"
    )


@query(
    "r19_continuation_predicate",
    f"""WITH src AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))))) AS line, unnest((string_split(text, chr(10)))[1:-2]) AS l,
      unnest((string_split(text, chr(10)))[2:]) AS r FROM documents),
t AS (SELECT doc_id, line, trim(CASE WHEN line % 3 = 0 THEN rtrim(l, '.') WHEN line % 3 = 1 THEN rtrim(l, '.') || ' using' ELSE l END, {WS}) AS a,
      trim(CASE WHEN line % 2 = 0 THEN lower(r) ELSE r END, {WS}) AS b FROM src)
SELECT doc_id, line, {_continues_sql('a', 'b', 'FALSE', 'FALSE', 'TRUE', 'TRUE')} AS continues FROM t""",
)
def r19(spark, sf):
    lines = F.split("text", "\n")
    d = X.table(spark, sf, "documents").select("doc_id", lines.alias("ls"))
    pairs = d.select(
        "doc_id",
        F.posexplode(
            F.arrays_zip(
                F.slice("ls", F.lit(1), F.size("ls") - 1).alias("l"), F.slice("ls", F.lit(2), F.size("ls") - 1).alias("r")
            )
        ).alias("i", "p"),
    )
    line = F.col("i") + 1
    left, right = F.col("p")["l"], F.col("p")["r"]
    cut = F.rtrim(left, F.lit("."))
    a = F.when(line % 3 == 0, cut).when(line % 3 == 1, F.concat(cut, F.lit(" using"))).otherwise(left)
    b = F.when(line % 2 == 0, F.lower(right)).otherwise(right)
    side = lambda t: F.struct(
        t.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("centered"), F.lit("native_text").alias("kind"), F.lit(11.0).alias("font_size")
    )
    return pairs.select("doc_id", line.cast("bigint").alias("line"), side(a).alias("a"), side(b).alias("b")).select(
        "doc_id", "line", L.continues(F.col("a"), F.col("b")).alias("continues")
    )


CHAINS = f"""{BODY}, {PAIRS.format(src='body')},
tr AS (SELECT *, trim(text, {WS}) AS ta, trim(n_text, {WS}) AS tb FROM pairs),
lk AS (SELECT doc_id, region_id, page_index, seq, length(text) AS n, coalesce(boundary IS NOT NULL AND
   {_continues_sql('ta', 'tb', 'bold', 'n_bold', 'kind = n_kind', 'abs(font_size - n_font) <= greatest(0.75, font_size * 0.12)')}, FALSE) AS link FROM tr),
ch AS (SELECT doc_id, seq, region_id, link, n AS chars, seq AS first, 1::BIGINT AS member_no FROM lk WHERE seq = 1
  UNION ALL SELECT l.doc_id, l.seq, l.region_id, l.link, CASE WHEN c.link AND c.chars + l.n <= CAP_CHARS THEN c.chars + l.n ELSE l.n END,
     CASE WHEN c.link AND c.chars + l.n <= CAP_CHARS THEN c.first ELSE l.seq END, CASE WHEN c.link AND c.chars + l.n <= CAP_CHARS THEN c.member_no + 1 ELSE 1 END
  FROM ch c JOIN lk l ON l.doc_id = c.doc_id AND l.seq = c.seq + 1),
sz AS (SELECT doc_id, first, count(*) AS group_size FROM ch GROUP BY ALL),
chains AS (SELECT c.doc_id, c.region_id, f.region_id AS group_id, c.member_no, s.group_size FROM ch c JOIN sz s USING (doc_id, first) JOIN lk f ON f.doc_id = c.doc_id AND f.seq = c.first)"""


def _linked(spark, sf, cap):
    return L.link_continuations(_typed(spark, sf), max_chars=cap).select(
        "doc_id", "region_id", "group_id", "member_no", "group_size"
    )


@query("r20_chain_groups", f"WITH RECURSIVE {CHAINS.replace('CAP_CHARS', '12000')} SELECT * FROM chains")
def r20(spark, sf):
    return _linked(spark, sf, 12000)


@query("r20_chain_groups_capped", f"WITH RECURSIVE {CHAINS.replace('CAP_CHARS', '400')} SELECT * FROM chains")
def r20_capped(spark, sf):
    return _linked(spark, sf, 400)


@query(
    "r21_layout_text",
    f"""WITH s AS (SELECT doc_id, doc_id % 2 = 0 AS native, CASE WHEN doc_id % 6 = 4 THEN '1. ' || text ELSE text END AS src,
   trim(CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, ', ', '，') END, {WS}) AS t FROM documents)
SELECT doc_id, CASE WHEN native THEN CASE WHEN contains(src, chr(10) || chr(10)) OR regexp_matches(src, '{L.LIST_LINE}') THEN t ELSE replace(t, chr(10), ' ') END
  ELSE replace(replace(replace(replace(t, '、', ','), '，', ','), '：', ':'), '。', '.') END AS text FROM s""",
)
def r21(spark, sf):
    native = F.col("doc_id") % 2 == 0
    src = F.when(F.col("doc_id") % 6 == 4, F.concat(F.lit("1. "), "text")).otherwise(F.col("text"))
    t = F.when(native, F.col("text")).otherwise(F.replace(F.col("text"), F.lit(", "), F.lit("，")))
    kind = F.when(native, "native_text").otherwise("image_ocr")
    return X.table(spark, sf, "documents").select("doc_id", L.layout_text(t, src, kind).alias("text"))


@query(
    "r22_unchanged_translation",
    """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE
       ELSE upper(regexp_replace(text, '\\s', '', 'g')) = regexp_replace(text, '\\s', '', 'g') END AS unchanged FROM conversations""",
)
def r22(spark, sf):
    k = F.col("conv_id") % 4
    # Full-width letters and an ideographic stop are the same text in NFKC.
    wide = F.translate(F.col("text"), "abcde,", "ａｂｃｄｅ，")
    t = (
        F.when(k == 0, F.col("text"))
        .when(k == 1, F.replace(F.col("text"), F.lit(" "), F.lit("\n ")))
        .when(k == 2, F.replace(wide, F.lit("."), F.lit("。")))
        .otherwise(F.upper("text"))
    )
    c = X.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("source_text"), t.alias("translated_text"))
    return L.unchanged_translation(c).select("conv_id", "turn", "unchanged")


@query(
    "r23_layout_flags",
    f"""WITH {REGIONS}, v AS (SELECT doc_id, region_id, line % 3 = 0 AS centered, font_size, line % 2 = 0 AS ocr,
   CASE WHEN line % 5 = 0 THEN 20.0::DOUBLE ELSE w END AS w, CASE WHEN line % 7 = 0 THEN w ELSE h END AS h, CASE WHEN line % 4 = 0 THEN replace(text, ' ', '-') ELSE text END AS text FROM regions)
SELECT doc_id, region_id, centered AND (length(text) <= 200 OR font_size >= 16) AS centre,
   ocr AND h > w * 2.5 AND length(text) > 3 AND regexp_matches(text, '[A-Za-z]') AS vertical_label,
   ocr AND length(text) >= 12 AND contains(text, '-') AND NOT regexp_matches(text, '\\s') AND w / greatest(1, h) BETWEEN 0.8 AND 1.25 AS diagonal_label FROM v""",
)
def r23(spark, sf):
    n = F.col("line")
    v = (
        X.regions(spark, sf)
        .withColumn("centered", n % 3 == 0)
        .withColumn("kind", F.when(n % 2 == 0, "image_ocr").otherwise("native_text"))
        .withColumn("h", F.when(n % 7 == 0, F.col("w")).otherwise(F.col("h")))
        .withColumn("w", F.when(n % 5 == 0, F.lit(20.0)).otherwise(F.col("w")))
        .withColumn("text", F.when(n % 4 == 0, F.replace(F.col("text"), F.lit(" "), F.lit("-"))).otherwise(F.col("text")))
    )
    return L.layout_flags(v).select("doc_id", "region_id", "centre", "vertical_label", "diagonal_label")


def _objects(spark, sf):
    n = F.col("line")
    return X.regions(spark, sf).select(
        "doc_id",
        "page_index",
        n.alias("object_no"),
        F.when(n % 13 == 11, "image").when(n % 13 == 10, "path").otherwise("text").alias("object_type"),
        F.when(n % 5 != 4, F.format_string("m%d", F.floor(n % 12 / 4).cast("int"))).alias("mark"),
        "text",
        "x", "y", "w", "h", "font_size",
        (700.0 - 100.0 * F.floor(n % 6 / 2)).alias("baseline"),
        (F.col("x") + n % 3).alias("origin_x"),
        F.when(n % 4 != 0, F.format_string("#%06d", n.cast("int"))).alias("color"),
        F.when(n % 17 == 3, "rotated").when(n % 17 == 4, "hidden").alias("limitation"),
    )


OBJECTS = f"""{REGIONS},
objects AS (SELECT doc_id, page_index, line AS object_no, CASE WHEN line % 13 = 11 THEN 'image' WHEN line % 13 = 10 THEN 'path' ELSE 'text' END AS object_type,
   CASE WHEN line % 5 <> 4 THEN 'm' || ((line % 12) // 4) END AS mark, text, x, y, w, h, font_size, (700 - 100 * ((line % 6) // 2))::DOUBLE AS baseline,
   (x + line % 3)::DOUBLE AS origin_x, CASE WHEN line % 4 <> 0 THEN printf('#%06d', line) END AS color,
   CASE WHEN line % 17 = 3 THEN 'rotated' WHEN line % 17 = 4 THEN 'hidden' END AS limitation FROM regions)"""


@query(
    "r24_group_text_objects",
    f"""WITH {OBJECTS},
t AS (SELECT *, coalesce(mark, '#' || object_no) AS g FROM objects WHERE object_type = 'text' AND trim(text, {WS}) <> ''),
l AS (SELECT *, CASE WHEN abs(lag(baseline) OVER (PARTITION BY doc_id, page_index, g ORDER BY object_no) - baseline) > font_size * 0.5 THEN chr(10) ELSE '' END || text AS tt FROM t)
SELECT doc_id, page_index, min(object_no) AS first_object, string_agg(object_no::VARCHAR, ',' ORDER BY object_no) AS objects, string_agg(tt, '' ORDER BY object_no) AS text,
  min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, arg_min(baseline, object_no) AS baseline, arg_min(font_size, object_no) AS font_size,
  arg_min(origin_x, object_no) AS origin_x, arg_min_null(color, object_no) AS color,
  arg_min(limitation, object_no) FILTER (WHERE limitation IS NOT NULL) AS limitation FROM l GROUP BY doc_id, page_index, g""",
)
def r24(spark, sf):
    return L.group_text_objects(_objects(spark, sf))


@query(
    "r24_object_counts",
    f"""WITH {OBJECTS} SELECT doc_id, page_index, count(*) FILTER (WHERE object_type = 'text') AS texts, count(*) FILTER (WHERE object_type = 'image') AS images,
   count(*) FILTER (WHERE object_type = 'path') AS paths FROM objects GROUP BY ALL""",
)
def r24_counts(spark, sf):
    return L.object_counts(_objects(spark, sf))


# Every third document gets appendix pages, eight texts to a page; documents count one more page than their regions show.
REPORT = f"""{REGIONS},
t AS (SELECT doc_id, length(text) > 300 AS over, kind, region_id FROM regions),
o AS (SELECT doc_id, string_agg(region_id, ',' ORDER BY region_id) AS ids, count(*) AS n FROM t WHERE over GROUP BY doc_id),
k AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'native_text') AS native_regions, count(*) FILTER (WHERE kind = 'image_ocr') AS ocr_regions FROM t GROUP BY doc_id),
p AS (SELECT doc_id, (len(string_split(text, chr(10))) - 1) // 12 + 2 AS n_pages FROM documents),
r AS (SELECT p.*, k.*, o.ids, coalesce(o.n, 0) AS n, CASE WHEN p.doc_id % 3 = 0 AND o.n > 0 THEN (o.n - 1) // 8 + 1 ELSE 0 END AS extra
  FROM p LEFT JOIN k ON k.doc_id = p.doc_id LEFT JOIN o ON o.doc_id = p.doc_id)"""


@query(
    "r25_layout_report",
    f"""WITH {REPORT}
SELECT doc_id, (n_pages + extra)::BIGINT AS page_count, coalesce(native_regions, 0) AS native_regions, coalesce(ocr_regions, 0) AS ocr_regions,
  CASE WHEN extra = 0 THEN coalesce(ids, '') ELSE '' END AS overflow_ids, CASE WHEN extra > 0 THEN ids ELSE '' END AS supplemented_ids, n AS n_overflow FROM r""",
)
def r25(spark, sf):
    r = X.regions(spark, sf)
    over = r.filter(F.length("text") > 300).select("doc_id", "region_id")
    n_pages = F.floor((F.size(F.split("text", "\n")) - 1) / 12) + 2
    pages = X.table(spark, sf, "documents").select("doc_id", n_pages.alias("n_pages"))
    notes = over.filter("doc_id % 3 = 0").groupBy("doc_id").agg(F.expr("(count(1) - 1) div 8 + 1").alias("n_pages"))
    return L.layout_report(r, over, pages, notes)


def _groups(spark, sf):
    """Triples of lines as groups; some documents are damaged in one way each."""
    n, d = F.col("line"), F.col("doc_id") % 6
    src = (
        X.table(spark, sf, "documents")
        .withColumn("total", F.size(F.split("text", "\n")))
        .select("doc_id", "total", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    )
    first = (F.floor(n / 3) * 3).cast("bigint")
    name = lambda v: F.concat(F.lit("r"), v.cast("string"))
    full = F.array(name(first), name(first + 1), name(first + 2))
    group = (
        F.when(first + 2 >= F.col("total"), F.lit(None))
        .when((d == 1) & (n % 3 == 1), F.slice(full, 1, 2))
        .when(d == 3, F.array(name(first), name(first), name(first + 2)))
        .otherwise(full)
    )
    return src.select(
        "doc_id",
        F.when((d == 4) & (n % 7 == 3), name(n - 1)).otherwise(name(n)).alias("region_id"),
        (F.floor(n / 12) + F.when((d == 2) & (n % 3 == 2), F.lit(5)).otherwise(F.lit(0))).cast("bigint").alias("page_index"),
        group.alias("continuation"),
    )


@query(
    "r26_continuation_integrity",
    f"""WITH {REGIONS}, tot AS (SELECT doc_id, count(*) AS total FROM regions GROUP BY doc_id),
s AS (SELECT doc_id, line, doc_id % 6 AS d, line // 3 * 3 AS f, total FROM regions JOIN tot USING (doc_id)),
g AS (SELECT doc_id, CASE WHEN d = 4 AND line % 7 = 3 THEN 'r' || (line - 1) ELSE 'r' || line END AS region_id, line // 12 + CASE WHEN d = 2 AND line % 3 = 2 THEN 5 ELSE 0 END AS page_index,
   CASE WHEN f + 2 >= total THEN NULL WHEN d = 1 AND line % 3 = 1 THEN ['r' || f, 'r' || (f + 1)] WHEN d = 3 THEN ['r' || f, 'r' || f, 'r' || (f + 2)]
        ELSE ['r' || f, 'r' || (f + 1), 'r' || (f + 2)] END AS c FROM s),
dup AS (SELECT doc_id, 'repeated_id' AS code FROM g GROUP BY doc_id, region_id HAVING count(*) > 1),
gs AS (SELECT DISTINCT doc_id, c FROM g WHERE c IS NOT NULL),
shape AS (SELECT doc_id, 'bad_shape' FROM gs WHERE len(c) < 2 OR len(list_distinct(c)) < len(c)),
own AS (SELECT doc_id, region_id, min(page_index) AS page_index, CASE WHEN count(*) = 1 THEN any_value(c) END AS c FROM g GROUP BY doc_id, region_id),
m AS (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS region_id FROM gs),
j AS (SELECT m.doc_id, m.c, m.i, o.page_index, o.c AS oc, o.page_index - lag(o.page_index) OVER (PARTITION BY m.doc_id, m.c ORDER BY m.i) AS step
      FROM m LEFT JOIN own o ON o.doc_id = m.doc_id AND o.region_id = m.region_id),
u AS (SELECT * FROM dup UNION ALL SELECT * FROM shape UNION ALL SELECT doc_id, 'members_disagree' FROM j WHERE oc IS DISTINCT FROM c
      UNION ALL SELECT doc_id, 'page_step' FROM j WHERE step NOT BETWEEN 0 AND 1)
SELECT doc_id, code, count(*) AS n FROM u GROUP BY ALL""",
)
def r26(spark, sf):
    return L.check_groups(_groups(spark, sf))
