"""Page operators. A page row is keyed by (doc_id, page_no); numbering is dense
from 1 and ``n_pages`` travels with every page, so most edits are projections:
no window and no shuffle. Box columns are x0, y0, x1, y1.
"""

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import page_spec as S
from quire.functions import text as T
from quire.functions.scale import running_total

PAGE_BOX = (0.0, 0.0, 595.0, 842.0)
BOX = ["x0", "y0", "x1", "y1"]


def explode_pages(docs, sep="\n", box=PAGE_BOX, text="text"):
    """One row per page with its 1-based number and its document's page count."""
    keep = [c for c in docs.columns if c != text]
    # Counted before the explode, once per document.
    counted = docs.withColumn("n_pages", F.size(F.split(text, sep)).cast("bigint"))
    return counted.select(*keep, "n_pages", F.posexplode(F.split(text, sep)).alias("_pos", "text")).select(
        *keep,
        (F.col("_pos") + 1).cast("bigint").alias("page_no"),
        "n_pages",
        "text",
        F.lit(0).alias("rotation"),
        *[F.lit(v).alias(c) for c, v in zip(BOX, box)],
    )


def page_count(pages):
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))


def select_pages(pages, spec):
    """Pages of a lenient spec; ``sel_no`` is the rank among the selected pages."""
    chosen = S.selection(spec, F.col("n_pages"))
    return pages.filter(chosen.contains(F.col("page_no"))).withColumn("sel_no", chosen.rank(F.col("page_no")))


def page_indexes(docs, spec):
    """Strict spec per document: ``error`` or the 0-based page list in order."""
    n = F.col("n_pages")
    return docs.select(
        *docs.columns,
        S.strict_error(spec, n).alias("error"),
        F.transform(S.strict_pages(spec, n), lambda p: p - 1).alias("indexes"),
    )


def reorder_pages(pages, spec):
    """New order by an order-preserving spec; pages may repeat or be dropped.
    A spec that names no existing page changes nothing."""
    order = S.ordering(spec, F.col("n_pages"))
    keep = [c for c in pages.columns if c not in ("page_no", "n_pages")]
    changed = order.total() > 0
    return pages.select(
        *keep,
        F.col("page_no").alias("from_page"),
        F.when(changed, order.total()).otherwise(F.col("n_pages")).alias("n_pages"),
        F.explode(
            F.when(changed, order.positions(F.col("page_no"))).otherwise(F.array("page_no"))
        ).alias("page_no"),
    )


def reorder_check(docs, spec):
    """Strict order: every current page exactly once."""
    checked = docs.withColumn("_e", S.strict_error(spec, F.col("n_pages"))).withColumn(
        "_p", S.strict_pages(spec, F.col("n_pages"))
    )
    verdict = (
        F.when(F.col("_e").isNotNull(), F.col("_e"))
        .when(F.size("_p") == 0, "unchanged")
        .when(
            (F.size("_p") == F.col("n_pages")) & (F.size(F.array_distinct("_p")) == F.col("n_pages")),
            "ok",
        )
        .otherwise("not_a_permutation")
    )
    return checked.withColumn("verdict", verdict).drop("_e", "_p")


def delete_pages(pages, spec):
    """Remove the pages of a lenient spec and close the numbering. A blank spec
    removes nothing."""
    n, page, blank = F.col("n_pages"), F.col("page_no"), S.is_blank(spec)
    gone = S.selection(spec, n)
    kept = pages.filter(blank | ~gone.contains(page))
    return kept.withColumns(
        {
            "page_no": F.when(blank, page).otherwise(page - gone.rank(page)),
            "n_pages": F.when(blank, n).otherwise(n - gone.total()),
        }
    )


def delete_check(docs, spec):
    """Documents whose deletion leaves no page (refused by the native profile)."""
    n = F.col("n_pages")
    left = F.when(S.is_blank(spec), n).otherwise(n - S.selection(spec, n).total())
    return docs.withColumn("pages_left", left).withColumn("refused", F.col("pages_left") == 0)


def _selected(spec):
    """Selection of a page edit. Blank selects nothing; ``all`` selects every page.
    A strict spec (native) is a lenient one without its liberties, checked first by
    ``page_indexes``, so the same ranges serve both."""
    if spec.strip().lower() == "all":
        return F.lit(True)
    if not spec.strip():
        return F.lit(False)
    return S.selection(spec, F.col("n_pages")).contains(F.col("page_no"))


def rotate_pages(pages, spec, degrees, profile="web"):
    """web: set to the angle; native: add to the current one. Result in 0..359."""
    if profile == "native" and degrees % 90 != 0:
        raise ValueError("rotation must be a multiple of 90 degrees")
    turned = F.lit(degrees % 360) if profile == "web" else F.pmod(F.col("rotation") + degrees, F.lit(360))
    return pages.withColumn("rotation", F.when(_selected(spec), turned).otherwise(F.col("rotation")))


def crop_pages(pages, spec, box, profile="web"):
    """Set the crop box. ``crop_error`` marks native pages whose current box does
    not contain the new one; their box stays."""
    x0, y0, x1, y1 = [float(v) for v in box]
    if x0 >= x1 or y0 >= y1:
        raise ValueError("crop box needs x0 < x1 and y0 < y1")
    hit = _selected(spec)
    inside = (F.col("x0") <= x0) & (F.col("y0") <= y0) & (F.col("x1") >= x1) & (F.col("y1") >= y1)
    ok = hit if profile == "web" else hit & inside
    out = pages.withColumn("_ok", ok).withColumn(
        "crop_error", F.lit(False) if profile == "web" else hit & ~inside
    )
    for name, value in zip(BOX, (x0, y0, x1, y1)):
        out = out.withColumn(name, F.when(F.col("_ok"), F.lit(value)).otherwise(F.col(name)))
    return out.drop("_ok")


# Placement and style of the stamp per profile.
STAMP = {
    "web": {"x": 0.18, "y": 0.52, "font_size": 32, "angle": 25},
    "native": {"x": 0.12, "width": 0.76, "half_height": 32.0, "font_size": 30},
}


def stamp_watermark(pages, text, profile="web"):
    """One annotation row per page, placed from the page box."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = STAMP[profile]
    if profile == "web":
        spot = [
            (w * s["x"]).alias("ann_x"),
            (h * s["y"]).alias("ann_y"),
            F.lit(None).cast("double").alias("ann_w"),
            F.lit(None).cast("double").alias("ann_h"),
        ]
    else:
        spot = [
            (F.col("x0") + w * s["x"]).alias("ann_x"),
            ((F.col("y0") + F.col("y1")) / 2 - s["half_height"]).alias("ann_y"),
            (w * s["width"]).alias("ann_w"),
            F.lit(2 * s["half_height"]).alias("ann_h"),
        ]
    return pages.filter(F.lit(bool(text.strip()))).select(
        "doc_id",
        "page_no",
        *spot,
        F.lit(s["font_size"]).alias("ann_font"),
        F.lit(s.get("angle", 0)).alias("ann_angle"),
        F.lit(text.strip() if profile == "native" else text).alias("ann_text"),
    )


MAX_HITS_PER_PAGE = 5000


def replace_text(pages, find, replacement):
    """Literal, non-overlapping replacement with the hits per page."""
    if not find:
        return pages.withColumn("hits", F.lit(0).cast("bigint"))
    without = F.length(F.replace(F.col("text"), F.lit(find), F.lit("")))
    hits = F.length("text") - without
    return pages.withColumn("hits", (hits / F.lit(len(find))).cast("bigint")).withColumn(
        "text", F.replace(F.col("text"), F.lit(find), F.lit(replacement))
    )


def replace_selection(pages, page_no, start, find, replacement):
    """Replacement of one selected range: on page ``page_no``, at the 1-based
    ``start``. ``stale`` marks pages whose text there is no longer ``find``; they
    stay as they are."""
    start = F.lit(start) if isinstance(start, int) else start
    n = len(find)
    here = F.col("page_no") == page_no
    found = F.col("text").substr(start, F.lit(n)) == find
    made = F.concat(
        F.left("text", start - 1), F.lit(replacement), F.col("text").substr(start + n, F.length("text"))
    )
    return pages.withColumns(
        {
            "stale": here & ~((start > 0) & found),
            "text": F.when(here & (start > 0) & found, made).otherwise(F.col("text")),
        }
    )


def replace_report(replaced):
    """Per document: hits and verdict (``not_found`` / ``too_many`` / ``ok``)."""
    return (
        replaced.groupBy("doc_id")
        .agg(F.sum("hits").alias("hits"), F.max("hits").alias("page_max"))
        .withColumn(
            "verdict",
            F.when(F.col("hits") == 0, "not_found")
            .when(F.col("page_max") > MAX_HITS_PER_PAGE, "too_many")
            .otherwise("ok"),
        )
    )


def merge_documents(pages, order):
    """Documents one after the other, pages renumbered. ``order`` has one row per
    document (job_id, ord, doc_id, n_pages); the running total is taken on it,
    not on the pages, and in buckets so one huge job is spread."""
    offsets = (
        running_total(
            order,
            ["job_id"],
            F.expr("ord div 1024"),
            ["ord", "doc_id"],
            F.col("n_pages"),
            "_end",
        )
        .withColumn("_start", F.col("_end") - F.col("n_pages"))
        .select("job_id", "doc_id", "_start")
    )
    return pages.join(offsets, "doc_id").select(
        "job_id",
        (F.col("_start") + F.col("page_no")).alias("new_page_no"),
        "doc_id",
        "page_no",
        "text",
    )


def edit_pages(pages, opts, profile="web"):
    """Page edits in the profile's order; a later spec refers to the numbering the
    earlier edits left. Text replacement adds ``hits``; a watermark adds columns."""

    def reorder(p):
        spec = opts.get("reorder_pages", "")
        return reorder_pages(p, spec).drop("from_page") if spec.strip() else p

    def delete(p):
        spec = opts.get("delete_pages", "")
        return delete_pages(p, spec) if spec.strip() else p

    def rotate(p):
        spec = opts.get("rotate_pages", "")
        return rotate_pages(p, spec, int(opts.get("rotate_degrees", 90)), profile) if spec.strip() else p

    def crop(p):
        spec = opts.get("crop_pages", "")
        if not spec.strip():
            return p
        box = [float(v) for v in opts["crop_box"].split(",")]
        return crop_pages(p, spec, box, profile)

    def replace(p):
        find = opts.get("replace_find", "")
        return replace_text(p, find, opts.get("replace_with", "")) if find else p

    def watermark(p):
        text = opts.get("watermark", "")
        return p.withColumn("watermark", F.lit(text)) if text.strip() else p

    web = [reorder, delete, rotate, crop, watermark, replace]
    native = [delete, rotate, reorder, crop, replace, watermark]
    for step in web if profile == "web" else native:
        pages = step(pages)
    return pages


def preview_pages(pages, n=12, number="page_no"):
    """First ``n`` pages per document. Numbering is dense, so this is a filter that
    reaches the scan side rather than a ranked window."""
    return pages.filter(F.col(number) <= n)


def natural_order(df, name="name"):
    """Sort key of generated page names: the number after the last ``-``, else 0."""
    tail = F.trim(F.element_at(F.split(T.stem(F.col(name)), "-"), -1))
    return df.withColumn("page_key", F.coalesce(F.when(tail.rlike(r"^\+?[0-9]+$"), tail.try_cast("bigint")), F.lit(0).cast("bigint")))


def assemble_markdown(pages):
    """One text part per document of a job, to be written in order: pages joined
    by a rule, a blank line in front of every document but the first. A job of any
    size stays a set of parts, never one value."""
    return (
        pages.groupBy("job_id", "ord", "doc_id")
        .agg(_ordered_text(T.strip(F.col("text")), F.col("page_no"), "\n\n---\n\n").alias("_md"))
        .select(
            "job_id",
            "ord",
            "doc_id",
            F.concat(F.when(F.col("ord") == 1, F.lit("")).otherwise(F.lit("\n\n")), F.col("_md")).alias("markdown"),
        )
    )


def _ordered_text(value, order, sep):
    """Texts of a group joined in order."""
    pairs = F.sort_array(F.collect_list(F.struct(order, value.alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), sep)


def assemble_sections(texts):
    """Markup and office inputs: a rule between documents, and a ``# stem`` heading
    when the job has several. ``texts``: job_id, ord, n_docs, name, markdown."""
    return texts.select(
        "job_id",
        "ord",
        F.concat(
            F.when(F.col("ord") == 1, F.lit("")).otherwise(F.lit("\n\n---\n\n")),
            F.when(
                F.col("n_docs") > 1, F.concat(F.lit("# "), T.stem(F.col("name")), F.lit("\n\n"))
            ).otherwise(F.lit("")),
            F.col("markdown"),
        ).alias("markdown"),
    )


def assemble_ocr_text(pages, profile="web"):
    """web: ``## Page n`` sections of the non-blank pages, ending in a line break;
    native: page texts joined by a blank line, empty pages kept."""
    if profile == "native":
        return pages.groupBy("doc_id").agg(_ordered_text(F.col("text"), F.col("page_no"), "\n\n").alias("ocr_text"))
    clean = T.strip(F.col("text"))
    section = F.when(
        clean != "", F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), clean)
    )
    return pages.groupBy("doc_id").agg(
        F.concat(
            F.coalesce(_ordered_text_nonnull(section, F.col("page_no"), "\n\n"), F.lit("")), F.lit("\n")
        ).alias("ocr_text")
    )


def _ordered_text_nonnull(value, order, sep):
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(order, value.alias("t")))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), sep)


def fallback_text(pages, ocr):
    """Recognised text only for pages whose own text is blank. Only those pages
    are joined; the rest pass by without a shuffle."""
    own = T.strip(F.col("text"))
    keys = ["doc_id", "page_no"]
    full = pages.filter(own != "").select(*keys, own.alias("text"), F.lit("layer").alias("origin"))
    blank = (
        pages.filter(F.coalesce(own, F.lit("")) == "")
        .select(*keys)
        .join(ocr.select(*keys, F.col("text").alias("_o")), keys, "left")
        .select(*keys, F.coalesce("_o", F.lit("")).alias("text"), F.lit("ocr").alias("origin"))
    )
    return full.unionByName(blank)


def interleave_bilingual(pages, spec):
    """Selected pages: the translation, then the original; others pass once. New
    numbers follow from the count of selected pages so far. ``pages`` has page_no,
    source_text and translated_text beside its document key."""
    chosen = S.selection(spec, F.lit(2**31 - 1).cast("bigint"))
    page = F.col("page_no")
    sel, rank = chosen.contains(page), chosen.rank(page)
    keys = [c for c in pages.columns if c not in ("source_text", "translated_text")]

    def side(name, number, text):
        return F.struct(F.lit(name).alias("side"), number.alias("no"), F.col(text).alias("t"))

    original = side("original", page + rank, "source_text")
    both = F.array(side("translation", page + rank - 1, "translated_text"), original)
    return pages.select(*keys, F.explode(F.when(sel, both).otherwise(F.array(original))).alias("_s")).select(
        *keys, F.col("_s.side").alias("side"), F.col("_s.no").alias("new_page_no"), F.col("_s.t").alias("text")
    )


def compare_counts(a, b):
    """Documents are comparable when both page counts are equal and positive."""
    left = a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_a"))
    right = b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_b"))
    return left.join(right, "doc_id", "full_outer").select(
        "doc_id",
        F.coalesce("n_a", F.lit(0)).alias("n_a"),
        F.coalesce("n_b", F.lit(0)).alias("n_b"),
        F.coalesce((F.col("n_a") == F.col("n_b")) & (F.col("n_a") > 0), F.lit(False)).alias("comparable"),
    )


def pair_pages(orig, trans, supplemented=None):
    """Page-by-page pairs. A document pairs when its counts agree, or when the
    translation is longer and marked as supplemented; extra pages are appended.
    One pass: both sides are unioned and grouped by page, counts by document."""
    both = orig.select("doc_id", "page_no", F.col("text").alias("o"), F.lit(None).cast("string").alias("t")).unionByName(
        trans.select("doc_id", "page_no", F.lit(None).cast("string").alias("o"), F.col("text").alias("t"))
    )
    per_page = both.groupBy("doc_id", "page_no").agg(F.max("o").alias("o"), F.max("t").alias("t"))
    counts = both.groupBy("doc_id").agg(F.count("o").alias("n_o"), F.count("t").alias("n_t"))
    if supplemented is not None:
        counts = counts.join(supplemented.select("doc_id", F.lit(True).alias("_s")), "doc_id", "left")
    else:
        counts = counts.withColumn("_s", F.lit(False))
    ok = (F.col("n_o") > 0) & (
        (F.col("n_o") == F.col("n_t")) | ((F.col("n_o") < F.col("n_t")) & F.coalesce("_s", F.lit(False)))
    )
    return per_page.join(counts.select("doc_id", ok.alias("ok")), "doc_id").select(
        "doc_id",
        "page_no",
        F.when(~F.col("ok"), "rejected")
        .when(F.col("o").isNull(), "appended")
        .otherwise("paired")
        .alias("pair_kind"),
        F.col("o").alias("original_text"),
        F.col("t").alias("translated_text"),
    )


MAX_QUERY_CHARS = 256
MAX_MATCHES = 2000


def _starts(parts, size):
    """Places (from 0) at which the pieces of a text are joined by ``size`` characters."""
    return F.aggregate(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("out")).cast("struct<p:int,out:array<int>>"),
        lambda s, x: F.struct(
            (s["p"] + F.length(x) + size).alias("p"), F.concat(s["out"], F.array(s["p"] + F.length(x))).alias("out")
        ),
        lambda s: s["out"],
    )


def search(pages, query, shown=MAX_MATCHES):
    """All case- and accent-insensitive matches, numbered per document in document
    order; ``shown`` marks those a viewer lists. Positions are 1-based characters of
    the page, in the page as it is: marks that the folding drops count.

    Numbers are the matches of earlier pages plus the place in the page, so one row per
    page, not per match, is sorted within a document.
    """
    q = query.strip()
    folded = T.fold_python(q)
    if not folded or len(q) > MAX_QUERY_CHARS:
        raise ValueError("query must have 1 to 256 characters")
    letters = pages.select("doc_id", "page_no", T.fold_letters(F.col("text")).alias("_t"))
    marked = F.col("_t").rlike(T.MARKS)
    found = _starts(F.split(F.regexp_replace("_t", T.MARKS, ""), re.escape(folded), -1), F.lit(len(folded)))
    # runs of dropped marks: where they stood in the folded text, and how many marks stood up to there
    gaps = F.split("_t", T.MARKS, -1)
    runs = F.zip_with(_starts(gaps, F.lit(0)), F.regexp_extract_all("_t", F.lit(f"({T.MARKS})"), 1), lambda at, m: F.struct(at.alias("at"), F.length(m).alias("n")))
    shifted = F.transform(
        "_found",
        lambda p: p + F.aggregate(F.filter("_runs", lambda r: r["at"] <= p), F.lit(0), lambda n, r: n + r["n"]),
    )
    hits = (
        letters.select("doc_id", "page_no", found.alias("_found"), F.when(marked, runs).alias("_runs"))
        .select("doc_id", "page_no", F.when(F.col("_runs").isNull(), F.col("_found")).otherwise(shifted).alias("_found"))
    )
    before = W.partitionBy("doc_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    return (
        hits.withColumn("_before", F.coalesce(F.sum(F.size("_found")).over(before), F.lit(0)))
        .select("doc_id", "page_no", "_before", F.posexplode("_found").alias("_i", "_p"))
        .select(
            "doc_id", "page_no", (F.col("_p") + 1).cast("bigint").alias("char_pos"), (F.col("_before") + F.col("_i") + 1).cast("bigint").alias("match_no")
        )
        .withColumn("shown", F.col("match_no") <= shown)
    )


def match_neighbours(matches):
    """Next and previous match of each match, wrapping at both ends."""
    n = F.count(F.lit(1)).over(W.partitionBy("doc_id"))
    m = F.col("match_no")
    return matches.withColumn("_n", n).select(
        "doc_id",
        "match_no",
        (m % F.col("_n") + 1).alias("next_no"),
        ((m + F.col("_n") - 2) % F.col("_n") + 1).alias("prev_no"),
    )


def page_geometry(pages, max_dim=2400.0, cap=4.0, gutter=16.0):
    """Displayed size, side-by-side sheet width, raster scale and pixel size."""
    quarter = F.col("rotation") % 180 == 90
    raw_w, raw_h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = pages.withColumn("width", F.when(quarter, raw_h).otherwise(raw_w)).withColumn(
        "height", F.when(quarter, raw_w).otherwise(raw_h)
    )
    valid = (F.col("width") > 0) & (F.col("height") > 0)
    scale = F.when(valid, F.least(F.lit(max_dim) / F.greatest("width", "height"), F.lit(cap)))
    return out.withColumn("scale", scale).select(
        "doc_id",
        "page_no",
        "width",
        "height",
        (F.col("width") * 2 + gutter).alias("sheet_width"),
        "scale",
        F.greatest(F.lit(1), F.ceil(F.col("width") * F.col("scale"))).cast("bigint").alias("px_w"),
        F.greatest(F.lit(1), F.ceil(F.col("height") * F.col("scale"))).cast("bigint").alias("px_h"),
        (~valid).alias("invalid"),
    )


def pixel_totals(geometry):
    return geometry.groupBy("doc_id").agg(
        F.sum(F.col("px_w") * F.col("px_h")).alias("pixels"), F.count_if("invalid").alias("invalid_pages")
    )


def unchanged_output(source_pages, output_pages):
    """Documents whose text, white space collapsed, equals the source's. A blank
    page adds nothing, so pages are collapsed first and joined after."""

    def whole(pages, name):
        pieces = pages.select("doc_id", "page_no", T.collapse(F.col("text")).alias("_p"))
        return pieces.groupBy("doc_id").agg(
            _ordered_text_nonnull(F.nullif(F.col("_p"), F.lit("")), F.col("page_no"), " ").alias(name)
        )

    return whole(source_pages, "_a").join(whole(output_pages, "_b"), "doc_id").select(
        "doc_id", (F.col("_a") == F.col("_b")).alias("unchanged"), F.length("_a").cast("bigint").alias("n_chars")
    )
