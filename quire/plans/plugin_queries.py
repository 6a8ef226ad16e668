"""User functions over ``documents`` and ``conversations``."""

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quire.operators import plugins as U
from quire.plans import fixtures as X
from quire.plans.registry import query


@query(
    "u1_map_documents",
    """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN text END AS text, CASE WHEN doc_id % 10 = 0 THEN 'ValueError: bad file ' || doc_id END AS error FROM documents""",
)
def u1(spark, sf):
    def identity(row):
        if row["doc_id"] % 10 == 0:
            raise ValueError(f"bad file {row['doc_id']}")
        return {"text": row["text"]}

    d = X.table(spark, sf, "documents").select("doc_id", "text")
    return U.map_documents(d, identity, Ty.StructType([Ty.StructField("text", Ty.StringType())]))


@query(
    "u2_translate_regions",
    """SELECT conv_id, turn // 4 AS batch, 't' || turn AS id, CASE WHEN conv_id % 7 IN (3, 5) THEN NULL ELSE '<' || text || '>' END AS translation,
  CASE WHEN conv_id % 7 IN (2, 3) THEN 2 ELSE 1 END::BIGINT AS attempts, CASE conv_id % 7 WHEN 3 THEN 'incomplete' WHEN 5 THEN 'RuntimeError: refused' END AS error FROM conversations""",
)
def u2(spark, sf):
    """A translator that answers late, never, or with an error for some batches;
    the behaviour rides in the item ids' conversation number."""

    def translator(items, attempt):
        mode = int(items[0][1].split("\x1f")[0])
        if mode == 5:
            raise RuntimeError("refused")
        if mode == 3 or (mode == 2 and attempt == 1):
            return {}
        return {i: "<" + t.split("\x1f", 1)[1] + ">" for i, t in items}

    c = X.table(spark, sf, "conversations").select(
        "conv_id", F.expr("turn div 4").alias("batch"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"),
        F.concat((F.col("conv_id") % 7).cast("string"), F.lit("\x1f"), "text").alias("text"),
    )
    batches = c.groupBy("conv_id", "batch").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("items"))
    return U.translate_regions(batches, translator, ["conv_id", "batch"])


@query(
    "u3_recognize_pages",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 10 <> 0)
SELECT doc_id, i AS item_no, t AS text, 0.0::DOUBLE AS nx, i / 64 AS ny, 1.0::DOUBLE AS nw, 0.25::DOUBLE AS nh, (i % 4) / 4 AS confidence, NULL::VARCHAR AS error FROM l
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ValueError: unreadable' FROM documents WHERE doc_id % 10 = 0""",
)
def u3(spark, sf):
    def recogniser(content):
        if content.startswith(b"\xff"):
            raise ValueError("unreadable")
        lines = content.decode("utf-8").split("\n")
        return [(t, 0.0, i / 64, 1.0, 0.25, i % 4 / 4) for i, t in enumerate(lines)]

    raw = F.col("text").cast("binary")
    d = X.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw).alias("content")
    )
    return U.recognize_pages(d, recogniser, ["doc_id"])


@query(
    "u4_expand_page_spec",
    """WITH c AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
s AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS page_no FROM c),
sel AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS pos FROM s WHERE page_no <= 3 OR page_no >= 6 OR (n < 6 AND page_no >= n)),
runs AS (SELECT doc_id, 1 AS k, -page_no AS step, page_no FROM s WHERE page_no <= 3 UNION ALL SELECT doc_id, 2, page_no, page_no FROM s WHERE page_no = 2),
ord AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY k, step) - 1 AS pos FROM runs)
SELECT doc_id, 'select' AS mode, pos, page_no FROM sel UNION ALL SELECT doc_id, 'order', pos, page_no FROM ord""",
)
def u4(spark, sf):
    name = U.register_page_spec(spark)
    docs = X.table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n"))
    text = f"""SELECT doc_id, 'select' AS mode, s.pos, s.page_no FROM {{docs}}, LATERAL {name}('2-3,-2,6-', n, 'select') s
        UNION ALL SELECT doc_id, 'order' AS mode, s.pos, s.page_no FROM {{docs}}, LATERAL {name}('3-1,2', n, 'order') s"""
    return spark.sql(text, docs=docs)
