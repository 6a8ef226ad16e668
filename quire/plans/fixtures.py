"""Working tables derived from the given parquet tables, in Spark and in SQL."""

from pyspark.sql import functions as F

from quire.operators import pages as P


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The extensions given to derived file names.
EXTENSIONS = [".pdf", ".docx", ".md", ".html", ".csv", ".PNG", ".exe"]


def files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return d.select(
        "doc_id",
        F.expr("doc_id div 8").alias("job_id"),
        (F.col("doc_id") % 8 + 1).alias("ord"),
        F.concat(F.lit("doc-"), (F.col("doc_id") % 6).cast("string"), ext).alias("name"),
        F.when(F.col("doc_id") % 50 == 0, F.lit(0).cast("bigint")).otherwise(F.col("n_chars")).alias("size"),
    )


FILES = """files AS (
  SELECT doc_id, doc_id // 8 AS job_id, doc_id % 8 + 1 AS ord,
         'doc-' || (doc_id % 6) || (['.pdf','.docx','.md','.html','.csv','.PNG','.exe'])[doc_id % 7 + 1] AS name,
         CASE WHEN doc_id % 50 = 0 THEN 0 ELSE n_chars END AS size
  FROM documents)"""


def doc_pages(spark, sf_dir):
    """Lines of ``documents`` as the pages of a document."""
    return P.explode_pages(table(spark, sf_dir, "documents").select("doc_id", "text"))


DOC_PAGES = """doc_lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
doc_pages AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS page_no, len(lines) AS n_pages,
         unnest(lines) AS text, 0 AS rotation,
         0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 595.0::DOUBLE AS x1, 842.0::DOUBLE AS y1
  FROM doc_lines)"""


def regions(spark, sf_dir, with_text=True):
    """Twelve lines per page in two columns of six boxes."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    line = F.col("line")
    in_page = line % 12
    ocr = line % 13 == 12
    page = F.floor(line / 12).cast("bigint")
    ocr_no = F.expr("(line + 1) div 13 - (line div 12 * 12) div 13")
    number = F.when(ocr, ocr_no).otherwise(in_page + 1 - ocr_no)
    return lines.select(
        "doc_id",
        F.format_string(
            "p%04d-%s%04d", page + 1, F.when(ocr, F.lit("i")).otherwise(F.lit("t")), number
        ).alias("region_id"),
        page.alias("page_index"),
        line.cast("bigint").alias("line"),
        F.when(ocr, F.lit("image_ocr")).otherwise(F.lit("native_text")).alias("kind"),
        (50.0 + 270.0 * F.floor(in_page / 6)).alias("x"),
        (700.0 - 100.0 * (in_page % 6)).alias("y"),
        F.lit(240.0).alias("w"),
        F.lit(60.0).alias("h"),
        F.when(line % 11 == 10, F.lit(7.0)).otherwise(F.lit(11.0)).alias("font_size"),
        (line % 29 == 28).alias("bold"),
        F.lit(False).alias("centered"),
        F.lit(False).alias("preserve"),
        "text",
    )


REGIONS = """region_lines AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line,
         unnest(string_split(text, chr(10))) AS text FROM documents),
regions AS (
  SELECT doc_id,
         printf('p%04d-%s%04d', line // 12 + 1, CASE WHEN line % 13 = 12 THEN 'i' ELSE 't' END,
                row_number() OVER (PARTITION BY doc_id, line // 12, line % 13 = 12 ORDER BY line)) AS region_id,
         line // 12 AS page_index, line,
         CASE WHEN line % 13 = 12 THEN 'image_ocr' ELSE 'native_text' END AS kind,
         (50 + 270 * ((line % 12) // 6))::DOUBLE AS x, (700 - 100 * ((line % 12) % 6))::DOUBLE AS y,
         240.0::DOUBLE AS w, 60.0::DOUBLE AS h,
         CASE WHEN line % 11 = 10 THEN 7.0::DOUBLE ELSE 11.0::DOUBLE END AS font_size,
         line % 29 = 28 AS bold, FALSE AS centered, FALSE AS preserve, text
  FROM region_lines)"""


def layout_lines(spark, sf_dir):
    """Text lines before paragraph grouping: forty per page, one column, now and
    then an indent, a bold line, an over-tall box or a run on the same baseline."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    n = F.col("line").cast("bigint")
    slot = F.col("line") % 40
    same = (F.col("line") % 7 == 6) & (slot != 0)
    x = F.when(same, F.lit(265.0)).when(n % 5 == 0, F.lit(62.0)).otherwise(F.lit(50.0))
    return lines.select(
        "doc_id",
        F.floor(n / 40).cast("bigint").alias("page_index"),
        n.alias("line"),
        F.col("text"),
        x.alias("x"),
        F.when(same, 780.0 - 16.0 * (slot - 1)).otherwise(780.0 - 16.0 * slot).alias("y"),
        F.when(same, F.lit(120.0)).otherwise(F.lit(200.0) + (n * 37) % 12).alias("w"),
        F.when(n % 17 == 16, F.lit(40.0)).otherwise(F.lit(14.0)).alias("h"),
        F.when(n % 19 == 18, F.lit(15.0)).otherwise(F.lit(11.0)).alias("font_size"),
        (n % 23 == 22).alias("bold"),
        F.lit(0.0).alias("px0"),
        F.lit(0.0).alias("py0"),
        F.lit(595.0).alias("px1"),
        F.lit(842.0).alias("py1"),
    )


LAYOUT_LINES = """layout_src AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line,
         unnest(string_split(text, chr(10))) AS text FROM documents),
layout_lines AS (
  SELECT doc_id, line // 40 AS page_index, line, text,
         CASE WHEN line % 7 = 6 AND line % 40 <> 0 THEN 265.0::DOUBLE
              WHEN line % 5 = 0 THEN 62.0::DOUBLE ELSE 50.0::DOUBLE END AS x,
         CASE WHEN line % 7 = 6 AND line % 40 <> 0 THEN (780 - 16 * (line % 40 - 1))::DOUBLE
              ELSE (780 - 16 * (line % 40))::DOUBLE END AS y,
         CASE WHEN line % 7 = 6 AND line % 40 <> 0 THEN 120.0::DOUBLE
              ELSE (200 + (line * 37) % 12)::DOUBLE END AS w,
         CASE WHEN line % 17 = 16 THEN 40.0::DOUBLE ELSE 14.0::DOUBLE END AS h,
         CASE WHEN line % 19 = 18 THEN 15.0::DOUBLE ELSE 11.0::DOUBLE END AS font_size,
         line % 23 = 22 AS bold,
         0.0::DOUBLE AS px0, 0.0::DOUBLE AS py0, 595.0::DOUBLE AS px1, 842.0::DOUBLE AS py1
  FROM layout_src)"""


def job_events(spark, sf_dir):
    """``events`` read as saved job records."""
    e = table(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "signup", "queued")
        .when(F.col("event_type").isin("view", "click"), "running")
        .when(F.col("event_type") == "purchase", "done")
        .otherwise("failed")
    )
    return e.select(
        F.col("user_id").alias("job_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        status.alias("status"),
        F.col("value").alias("progress"),
        (F.col("value") > 150).alias("cancel"),
        "event_type",
    )


JOB_EVENTS = """job_events AS (
  SELECT user_id AS job_id, event_id, ts,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'
                         WHEN 'purchase' THEN 'done' ELSE 'failed' END AS status,
         value AS progress, value > 150 AS cancel, event_type
  FROM events)"""


def translations(spark, sf_dir):
    """User turn = source, the next turn when it is the assistant's = translation."""
    c = table(spark, sf_dir, "conversations")
    src = c.filter("role = 'user'").select(
        "conv_id", "turn", F.expr("turn div 2 + 1").alias("page_no"), F.col("text").alias("source_text")
    )
    dst = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translated_text")
    )
    return src.join(dst, ["conv_id", "turn"], "left").select(
        "conv_id", "page_no", "source_text", "translated_text"
    )


TRANSLATIONS = """translations AS (
  SELECT s.conv_id, s.turn // 2 + 1 AS page_no, s.text AS source_text, d.text AS translated_text
  FROM conversations s LEFT JOIN conversations d
    ON d.conv_id = s.conv_id AND d.turn = s.turn + 1 AND d.role = 'assistant'
  WHERE s.role = 'user')"""
