"""Checks over batches of jobs. Every check yields issue rows
(job_id, severity, stage, code, detail); ``preflight_report`` folds them, and
``batch_preflight`` makes the same report straight from counts per job.
Catalogue tables are literal and tiny, so they are broadcast; jobs and files are
only ever aggregated with map-side combine.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quire.functions import page_spec as S
from quire.functions import text as T
from quire.functions.scale import running_total
from quire import catalog as C
from quire.session import written

ISSUE = ["job_id", "severity", "stage", "code", "detail"]


def issues(df, stage, code, detail=None, severity="blocking"):
    wrap = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        "job_id",
        wrap(severity).alias("severity"),
        F.lit(stage).alias("stage"),
        wrap(code).alias("code"),
        (wrap(detail) if detail is not None else F.lit("")).alias("detail"),
    )


def resolve_route(requests, profile="native"):
    """``supported`` / ``disabled`` (both formats known, no route) / ``unknown``.
    The native profile also wants the route's kind to match the request's."""
    routes = C.routes(requests.sparkSession, profile).select(
        "source", "target", F.col("kind").alias("route_kind"), "route_no"
    )
    known = C.format_table(requests.sparkSession, profile).select("format", F.lit(True).alias("_known"))
    src = F.broadcast(known.withColumnRenamed("format", "source").withColumnRenamed("_known", "_ks"))
    dst = F.broadcast(known.withColumnRenamed("format", "target").withColumnRenamed("_known", "_kt"))
    hit = F.col("route_no").isNotNull()
    if profile == "native":
        hit = hit & (F.col("kind") == F.col("route_kind"))
    return (
        requests.join(F.broadcast(routes), ["source", "target"], "left")
        .join(src, "source", "left")
        .join(dst, "target", "left")
        .withColumn(
            "outcome",
            F.when(hit, "supported")
            .when(F.coalesce("_ks", F.lit(False)) & F.coalesce("_kt", F.lit(False)), "disabled")
            .otherwise("unknown"),
        )
        .withColumn("route_no", F.when(hit, F.col("route_no")))
        .drop("_ks", "_kt", "route_kind")
    )


def accept_flag(files, profile="native"):
    """``accepted``: the file's suffix is in its route's accept list. ``files`` has
    route_no and name; one broadcast join, no shuffle."""
    accept = C.accepts(files.sparkSession, profile).withColumn("accepted", F.lit(True))
    return (
        files.withColumn("ext", T.suffix(F.col("name")))
        .join(F.broadcast(accept), ["route_no", "ext"], "left")
        .withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    )


def accept_filter(files, profile="native"):
    """(accepted, rejected)."""
    flagged = accept_flag(files, profile)
    return flagged.filter("accepted"), flagged.filter("not accepted")


def batch_totals(files, profile="native"):
    """Files and bytes per job. Non-positive sizes are not summed natively."""
    size = F.col("size") if profile == "web" else F.greatest(F.col("size"), F.lit(0))
    return files.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("total_bytes"))


def batch_limits(files, limits, profile="native", max_files=C.MAX_FILES, text_limit=C.WEB_TEXT_LIMIT):
    """Jobs over their byte limit or file count, and files over the text cap.
    ``limits``: job_id, input_limit."""
    totals = batch_totals(files, profile).join(limits, "job_id")
    too_many = totals.filter(F.col("n_files") > max_files) if profile == "native" else totals.filter(F.lit(False))
    counted = totals if profile == "web" else totals.filter(F.col("n_files") <= max_files)
    too_large = counted.filter(F.col("total_bytes") > F.col("input_limit"))
    long_text = files.filter(F.col("size") > text_limit)
    return (
        issues(too_many, "limits", "too_many_files", F.col("n_files").cast("string"))
        .unionByName(issues(too_large, "limits", "upload_too_large", F.col("total_bytes").cast("string")))
        .unionByName(issues(long_text, "limits", "text_too_large", F.col("name")))
    )


def empty_files(jobs, files):
    """Jobs without files, and files whose size is not positive."""
    none = jobs.join(files.select("job_id").distinct(), "job_id", "left_anti")
    return issues(none, "files", "file_required").unionByName(
        issues(files.filter(F.col("size") <= 0), "files", "empty_file", F.col("name"))
    )


def cardinality_code(n):
    """Code of a job whose number of files does not suit its kind, else null."""
    edit, merge = F.col("kind") == "pdf_edit", F.col("edit_action") == "merge"
    single = (edit & ~merge) | (F.col("kind") == "pdf_translate")
    return F.when(edit & merge & (n < 2), "merge_requires_files").when(single & (n != 1), "single_file_required")


def input_cardinality(jobs, files):
    """merge wants at least two files; a single edit or a translation exactly one."""
    n = files.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    counted = jobs.join(n, "job_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = counted.withColumn("_code", cardinality_code(F.col("n"))).filter(F.col("_code").isNotNull())
    return issues(bad, "cardinality", F.col("_code"), F.col("n").cast("string"))


PROVIDERS = ["deepseek", "openai"]


def job_requirements(jobs, profile="web"):
    """Requirement rows of a job. The provider chosen by option replaces the
    route's; text OCR does not need the searchable-PDF tool."""
    needs = C.requirements(jobs.sparkSession, profile)
    rows = jobs.join(F.broadcast(needs), "route_no")
    default = F.col("dependency").isin(PROVIDERS)
    translate = F.col("kind") == "pdf_translate"
    return rows.filter(
        ~((F.col("kind") == "ocr") & (F.col("output_format") == "text") & (F.col("dependency") == "ocrmypdf"))
    ).withColumn(
        "dependency",
        F.when(translate & default, F.coalesce(F.nullif(F.col("provider"), F.lit("")), F.lit("deepseek"))).otherwise(
            F.col("dependency")
        ),
    )


def requirement_check(jobs, deps, profile="web"):
    """Missing required parts block, missing optional ones warn, an any-of group
    blocks only when no member is there. ``deps``: dependency, available."""
    rows = job_requirements(jobs, profile).join(deps, "dependency", "left")
    ok = F.coalesce("available", F.lit(False))
    rows = rows.withColumn("_ok", ok).withColumn(
        "_code", F.when(F.col("dependency").isin(PROVIDERS), "missing_provider").otherwise("missing_dependency")
    )
    plain = rows.filter(F.col("level").isin("required", "optional") & ~F.col("_ok"))
    must = plain.filter("level = 'required'")
    may = plain.filter("level = 'optional'")
    groups = (
        rows.filter(~F.col("level").isin("required", "optional"))
        .groupBy("job_id", "level")
        .agg(F.bool_or("_ok").alias("_any"), F.min(F.struct("pos", "dependency", "_code")).alias("_first"))
        .filter(~F.col("_any"))
    )
    return (
        issues(must, "requirements", F.col("_code"), F.col("dependency"))
        .unionByName(issues(may, "requirements", "optional_dependency_missing", F.col("dependency"), "warning"))
        .unionByName(issues(groups, "requirements", F.col("_first._code"), F.col("_first.dependency")))
    )


CONTROL = r"[\p{Cc}\p{Cf}  ]"
# Limits of option texts, and the allowed values of enumerations.
MAX_PAGE_SPEC = 4096
MAX_CROP_BOX = 256
MAX_REPLACE = 512
MAX_WATERMARK = 512
MAX_LANGUAGE = 64
MAX_OCR_LANGUAGE = 256
MAX_GLOSSARY = 20_000
ROTATIONS = ["-270", "-180", "-90", "90", "180", "270"]
OUTPUT_MODES = ["preserve_layout", "translated", "bilingual"]
OCR_OUTPUTS = ["searchable_pdf", "text"]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def crop_box_valid(spec):
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    v = [F.get(parts, F.lit(i)).try_cast("double") for i in range(4)]
    shape = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(NUMBER))
    order = (v[0] < v[2]) & (v[1] < v[3])
    finite = F.forall(F.array(*v), lambda x: F.abs(x) < F.lit(float("inf")))
    return F.coalesce(shape & order & finite, F.lit(False))


def failed_options():
    """The option rules a job breaks, as an array of (code, field) in the order the rules
    are listed; one string column per option key."""
    c = F.col
    filled = lambda name: T.strip(c(name)) != ""

    def rule(when, code, field):
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))

    edit = c("kind") == "pdf_edit"
    action = c("edit_action")
    single = edit & (action == "edit")
    translate = c("kind") == "pdf_translate"
    ocr_kind = c("kind") == "ocr"
    reads = translate | ocr_kind | (c("kind") == "extract_markdown")
    rules = [rule(edit & ~action.isin("edit", "merge"), "invalid_edit_action", "edit_action")]
    no_limit = F.lit(9_223_372_036_854_775_807)
    for field in ("delete_pages", "rotate_pages", "reorder_pages", "crop_pages"):
        long = F.length(field) > MAX_PAGE_SPEC
        bad = S.strict_error(T.strip(c(field)), no_limit) == "syntax"
        rules.append(rule(single & long, "page_selection_too_large", field))
        rules.append(rule(single & ~long & F.coalesce(bad, F.lit(False)), "invalid_page_selection", field))
    rules.append(rule(single & filled("rotate_pages") & ~c("rotate_degrees").isin(ROTATIONS), "invalid_rotation", "rotate_degrees"))
    wants_crop = single & filled("crop_pages")
    rules.append(rule(wants_crop & (F.length("crop_box") > MAX_CROP_BOX), "crop_box_too_large", "crop_box"))
    rules.append(rule(wants_crop & (F.length("crop_box") <= MAX_CROP_BOX) & ~crop_box_valid(c("crop_box")), "invalid_crop_box", "crop_box"))
    find, repl = c("replace_find"), c("replace_with")
    bad_replace = (
        (F.length(find) > MAX_REPLACE)
        | (F.length(repl) > MAX_REPLACE)
        | F.contains(find, F.lit("\n"))
        | F.contains(repl, F.lit("\n"))
        | ((find == "") & (repl != ""))
    )
    rules.append(rule(single & bad_replace, "invalid_text_replacement", "replace_find"))
    rules.append(rule(single & (F.length("watermark") > MAX_WATERMARK), "watermark_too_large", "watermark"))
    rules.append(rule(translate & ~c("provider").isin(PROVIDERS), "invalid_provider", "provider"))
    rules.append(rule(translate & ~c("output_mode").isin(OUTPUT_MODES), "invalid_translation_output", "output_mode"))
    for field in ("source_language", "target_language"):
        bad = ~filled(field) | (F.length(T.strip(c(field))) > MAX_LANGUAGE) | c(field).rlike(CONTROL)
        rules.append(rule(translate & bad, "invalid_" + field, field))
    rules.append(rule(translate & (F.length("glossary") > MAX_GLOSSARY), "glossary_too_large", "glossary"))
    rules.append(rule(ocr_kind & ~c("ocr_output_format").isin(OCR_OUTPUTS), "invalid_ocr_output", "ocr_output_format"))
    bad_lang = filled("ocr_language") & (
        (F.length(T.strip(c("ocr_language"))) > MAX_OCR_LANGUAGE) | c("ocr_language").rlike(CONTROL)
    )
    rules.append(rule(reads & bad_lang, "invalid_ocr_language", "ocr_language"))
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def option_issues(jobs):
    """Issues of each job's options: one projection and an explode of what failed."""
    return issues(
        jobs.select("job_id", F.explode(failed_options()).alias("_f")), "options", F.col("_f.code"), F.col("_f.field")
    )


def block_edit_valid(df):
    """Limits of an in-place text edit: UTF-16 length, font size, width, position."""
    # Half the bytes of the UTF-16 form is the number of UTF-16 units.
    units = F.octet_length(F.encode("text", "UTF-16BE")) / 2
    finite = lambda n: F.coalesce(F.abs(F.col(n)) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(n)
    ok = (units <= 20_000) & F.col("font_size").between(1, 300) & (F.col("width") >= 10)
    return df.withColumn("valid", ok & finite("font_size") & finite("width") & finite("x") & finite("y"))


def preflight_report(jobs, *streams):
    """One row per job: ok, and its blocking and warning codes with counts in stage
    order. Issues are counted per code first, so a job with a million bad files
    still folds a few dozen codes."""
    union = streams[0]
    for s in streams[1:]:
        union = union.unionByName(s)
    codes = union.groupBy("job_id", "severity", "stage", "code").agg(F.count(F.lit(1)).alias("n"))
    line = F.format_string("%s/%s:%d", "stage", "code", "n")
    folded = codes.groupBy("job_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("severity") == "blocking", line))).alias("_b"),
        F.sort_array(F.collect_list(F.when(F.col("severity") == "warning", line))).alias("_w"),
    )
    none = F.array().cast("array<string>")
    return jobs.select("job_id").join(folded, "job_id", "left").select(
        "job_id",
        (F.size(F.coalesce("_b", none)) == 0).alias("ok"),
        F.array_join(F.coalesce("_b", none), ",").alias("blocking"),
        F.array_join(F.coalesce("_w", none), ",").alias("warnings"),
    )


def batch_preflight(jobs, files, profile="native", max_files=C.MAX_FILES, text_limit=C.WEB_TEXT_LIMIT, options=False):
    """The report of ``preflight_report`` for the limits, files, cardinality and (with
    ``options``) option stages, without issue rows: every check on files is a conditional
    sum of one aggregate per job, every check on jobs reads those sums, and the codes are
    one array of (severity, stage, code, n) on the job's row.

    ``jobs`` (job_id, kind, edit_action, input_limit) is one row per job; a job without
    files has sums of zero, a null ``input_limit`` is no limit. A translation warns that
    its text leaves the machine. One exchange of partial sums and one of jobs.
    """
    c, zero = F.col, F.lit(0).cast("bigint")
    size = c("size") if profile == "web" else F.greatest(c("size"), F.lit(0))
    sums = files.groupBy(c("job_id").alias("_job")).agg(
        F.count(F.lit(1)).alias("_files"),
        F.sum(size).cast("bigint").alias("_bytes"),
        F.count_if(c("size") > text_limit).alias("_long"),
        F.count_if(c("size") <= 0).alias("_empty"),
    )
    files_of, bytes_of, long, empty = (F.coalesce("_" + k, zero) for k in ("files", "bytes", "long", "empty"))
    crowded = (files_of > max_files) if profile == "native" else F.lit(False)
    one = lambda when: F.when(when, F.lit(1).cast("bigint")).otherwise(zero)
    bad_count = cardinality_code(files_of)
    found = [
        ("blocking", "limits", F.lit("too_many_files"), one(crowded)),
        ("blocking", "limits", F.lit("upload_too_large"), one(~crowded & (bytes_of > c("input_limit")))),
        ("blocking", "limits", F.lit("text_too_large"), long),
        ("blocking", "files", F.lit("file_required"), one(files_of == 0)),
        ("blocking", "files", F.lit("empty_file"), empty),
        ("blocking", "cardinality", bad_count, one(bad_count.isNotNull())),
        ("warning", "translate", F.lit("remote_processing"), one(c("kind") == "pdf_translate")),
    ]
    entry = lambda severity, stage, code, n: F.struct(
        F.lit(severity).alias("severity"), F.lit(stage).alias("stage"), code.alias("code"), n.alias("n")
    )
    codes = F.filter(F.array(*[entry(*f) for f in found]), lambda e: e["n"] > 0)
    if options:
        names = F.transform(failed_options(), lambda f: f["code"])
        times = lambda code: F.size(F.filter(names, lambda other: other == code)).cast("bigint")
        codes = F.concat(codes, F.transform(F.array_distinct(names), lambda k: entry("blocking", "options", k, times(k))))
    lines = lambda severity: F.sort_array(
        F.transform(
            F.filter("_codes", lambda e: e["severity"] == severity),
            lambda e: F.format_string("%s/%s:%d", e["stage"], e["code"], e["n"]),
        )
    )
    return (
        jobs.join(sums, jobs["job_id"] == sums["_job"], "left")
        .select("job_id", codes.alias("_codes"))
        .select(
            "job_id",
            (F.size(lines("blocking")) == 0).alias("ok"),
            F.array_join(lines("blocking"), ",").alias("blocking"),
            F.array_join(lines("warning"), ",").alias("warnings"),
        )
    )


def canonical_options(jobs, options="options"):
    """Keep the option keys the job's kind uses, defaults for the rest."""
    allowed = F.create_map(
        *[x for k, keys in C.OPTION_KEYS.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in keys]))]
    )
    kept = F.map_filter(
        options, lambda k, v: F.array_contains(F.coalesce(F.try_element_at(F.col("_allowed"), F.col("kind")), F.array().cast("array<string>")), k)
    )
    defaults = F.create_map(*[x for k, v in C.OPTION_DEFAULTS for x in (F.lit(k), F.lit(v))])
    merged = F.transform_values(defaults, lambda k, v: F.coalesce(F.try_element_at(F.col("_kept"), k), v))
    return (
        jobs.withColumn("_allowed", allowed).withColumn("_kept", kept).withColumn(options, merged).drop("_allowed", "_kept")
    )


def dependency_profile(spark, profile="web"):
    """Dependencies of each route in first-seen order over its engines, and the
    joined licence notes."""
    engines = C.engines(spark)
    used = (
        C.routes(spark, profile)
        .select("route_no", F.posexplode(F.split("engines", ",")).alias("eng_pos", "engine"))
        .join(F.broadcast(engines), "engine")
    )
    first = used.groupBy("route_no", "dependency").agg(F.min(F.struct("eng_pos", "dep_pos")).alias("seen"))
    listed = (
        first.join(F.broadcast(C.dependencies(spark)), "dependency")
        .groupBy("route_no")
        .agg(F.sort_array(F.collect_list(F.struct("seen", "dependency", "category", "risk"))).alias("_d"))
    )
    notes = (
        used.groupBy("route_no", "note")
        .agg(F.min("eng_pos").alias("p"))
        .groupBy("route_no")
        .agg(F.sort_array(F.collect_list(F.struct("p", "note"))).alias("_n"))
    )
    return listed.join(notes, "route_no").select(
        "route_no",
        F.array_join(F.transform("_d", lambda d: d["dependency"]), ",").alias("dependencies"),
        F.array_join(F.transform("_n", lambda n: n["note"]), " ").alias("license_note"),
    )


def translation_budget(pages, max_pages=C.MAX_PAGES, max_chars=C.MAX_CHARS):
    """Per document: pages, characters, and the page where the running total first
    breaks the budget. Only documents over it are ranked."""
    from pyspark.sql import Window as W

    sized = pages.select("doc_id", "page_no", F.length("text").cast("bigint").alias("n"))
    totals = sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_chars"))
    over = totals.filter(F.col("n_chars") > max_chars).select("doc_id")
    run = F.sum("n").over(W.partitionBy("doc_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, 0))
    breaks = (
        sized.join(over, "doc_id", "left_semi")
        .withColumn("_run", run)
        .filter(F.col("_run") > max_chars)
        .groupBy("doc_id")
        .agg(F.min("page_no").alias("break_page"))
    )
    return totals.join(breaks, "doc_id", "left").withColumn(
        "verdict",
        F.when(F.col("n_pages") > max_pages, "too_many_pages")
        .when(F.col("n_chars") > max_chars, "too_many_chars")
        .otherwise("ok"),
    )


def dedup_imports(existing, new):
    """Append new files; the first occurrence of a resolved path in a job wins.
    A ``min`` per path with map-side combine rather than a ranked window."""
    from quire.sources.results import resolve_path

    both = existing.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rest = [c for c in existing.columns if c != "job_id"]
    return (
        both.withColumn("_path", resolve_path(F.col("path")))
        .groupBy("job_id", "_path")
        .agg(F.min(F.struct("_side", *rest)).alias("_f"))
        .select("job_id", F.col("_f._side").alias("side"), *[F.col(f"_f.{c}").alias(c) for c in rest])
    )


def _ancestors(stem):
    """A stem and what is left of it as its trailing -digits are cut one by one."""
    tail = F.regexp_extract(stem, r"((?:-[0-9]+)*)$", 1)
    root = F.left(stem, F.length(stem) - F.length(tail))
    steps = F.split(tail, "-")
    return F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.concat(root, F.array_join(F.slice(steps, F.lit(1), i), "-")),
    )


_FREE, _AT = Ty.BooleanType(), Ty.LongType()
MEETING = Ty.ArrayType(Ty.StructType().add("free0", _FREE).add("free1", _FREE).add("at0", _AT).add("at1", _AT))


@F.pandas_udf(MEETING)
def _meet(numbers: pd.Series, before: pd.Series) -> pd.Series:
    """What becomes of the given names ``p-k`` of a stem ``p``, in order of ``k``.

    ``before``: files of ``p`` ahead of the given name's first file. Generated names take the
    free numbers from 2 on, so ``k`` is still free when its own file comes if numbers used up
    and numbers left out so far do not reach it; it is then left out by all later ones.
    Counted twice: with the first file of ``p`` numbered itself (0) or bearing the plain name
    (1). ``at`` is the number of generated names that stand before a number left out.
    """

    def one(ks, ns):
        out, left = [], [0, 0]
        for k, n in zip(ks, ns):
            row = {}
            for t in (0, 1):
                free = left[t] < k - 1 - max(n - t, 0)
                left[t] += free
                row[f"free{t}"], row[f"at{t}"] = bool(free), int(k - left[t]) if free else None
            out.append(row)
        return out

    return pd.Series([one(*pair) for pair in zip(numbers, before)])


def unique_names(files, bucket=None):
    """Case-insensitively unique names and stems inside a job: a taken one gets
    -2, -3, … in upload order.

    A file's number follows from counts. Files of one stem are numbered bucket by bucket,
    however many there are. A name that a stem ``p`` generates, ``p-k``, can only meet files
    given the stem ``p-k``; what counts of those is when the first one comes. So the given
    numbers of a stem, which are few, are settled from three counts (``_meet``); numbers left
    out then move later ones up, again by a running count; and whether the first file of
    ``p-k`` bears its plain name passes down along chains such as ``a``, ``a-2``, ``a-2-2``.
    """
    key = ["job_id", "_stem"]
    bucket = F.expr("ord div 256") if bucket is None else bucket
    base = files.select("job_id", "ord", "name").withColumn("_stem", F.lower(T.stem(F.col("name"))))
    stems = base.groupBy(*key).agg(F.min("ord").alias("_first"), F.count(F.lit(1)).alias("_n"))
    form = r"(?s)^(.+)-([2-9]|[1-9][0-9]{1,17})$"
    given = stems.filter(F.col("_stem").rlike(form)).select(
        "job_id", F.col("_stem").alias("_child"), F.regexp_extract("_stem", form, 1).alias("_stem"),
        F.regexp_extract("_stem", form, 2).cast("long").alias("_k"), F.col("_first").alias("ord"),
    )
    # one file of a plain stem generates nothing
    able = stems.filter((F.col("_n") > 1) | F.col("_stem").rlike(form)).select(*key)
    given = given.join(able, key, "left_semi")
    events = base.select(*key, "ord", "name", F.lit(None).cast("string").alias("_child"), F.lit(None).cast("long").alias("_k"), F.lit(1).alias("_file"))
    events = events.unionByName(given.withColumn("name", F.lit(None).cast("string")).withColumn("_file", F.lit(0)))
    counted = written(running_total(events, key, bucket, ["ord"], F.col("_file"), "_upto"), "names-counted")
    met = (
        counted.filter("_file = 0").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_k", "_upto", "_child"))).alias("_g"))
        .withColumn("_m", _meet("_g._k", "_g._upto"))
        .select(*key, F.explode(F.arrays_zip("_g", "_m")).alias("_z"))
        .select("job_id", F.col("_stem").alias("_parent"), F.col("_z._g._child").alias("_stem"), "_z._m.*")
    )
    # down each chain from its top: does the first file of a given stem, and of the one before it, bear its plain name?
    chain = met.select(*key, "_parent", "at0", "at1", F.posexplode(_ancestors(F.col("_stem"))).alias("_depth", "_form"))
    link = met.select("job_id", F.col("_stem").alias("_form"), F.struct("free0", "free1").alias("_free"))
    links = chain.join(link, ["job_id", "_form"], "left").groupBy(*key, "_parent", "at0", "at1").agg(
        F.sort_array(F.collect_list(F.struct("_depth", "_free"))).alias("_links")
    )
    plain = lambda chain: F.aggregate(
        chain, F.lit(True), lambda t, v: F.when(v["_free"].isNull(), F.lit(True)).when(t, v["_free"]["free1"]).otherwise(v["_free"]["free0"])
    )
    settled = written(
        links.select(*key, "_parent", "at0", "at1", plain(F.col("_links")).alias("_plain"), plain(F.slice("_links", 1, F.size("_links") - 1)).alias("_parent_plain")),
        "names-settled",
    )
    left_out = settled.select(
        "job_id", F.col("_parent").alias("_stem"), F.when(F.col("_parent_plain"), F.col("at1")).otherwise(F.col("at0")).alias("_at")
    ).filter("_at IS NOT NULL")
    bears = settled.select(*key, "_plain")
    rows = counted.filter("_file = 1").join(bears, key, "left").select(
        *key, "ord", "name", (F.col("_upto") - F.coalesce("_plain", F.lit(True)).cast("int")).cast("long").alias("_at")
    )
    both = rows.withColumn("_own", F.lit(0)).unionByName(left_out.withColumn("_own", F.lit(1)), allowMissingColumns=True)
    rows = running_total(both, key, F.expr("_at div 256"), ["_at", F.col("_own").desc()], F.col("_own"), "_out").filter("_own = 0")
    number = F.when(F.col("_at") == 0, F.lit(1).cast("long")).otherwise(F.col("_at") + 1 + F.col("_out"))
    ext = F.regexp_extract("name", r"[^./](\.[^./]+)$", 1)
    return rows.withColumn("_number", number).select(
        "job_id", "ord", "name",
        F.when(F.col("_number") == 1, F.col("name"))
        .otherwise(F.concat(T.stem(F.col("name")), F.lit("-"), F.col("_number").cast("string"), ext))
        .alias("unique_name"),
    )


MAX_STEM = 80


def safe_stem(name):
    """Leading upload number dropped, unsafe characters to ``-``, trimmed, cut."""
    bare = T.stem(F.regexp_replace(name, r"^[0-9]+-", ""))
    safe = F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{M}\p{N}\-_ ]", "-"), r"^[\- ]+|[\- ]+$", "")
    return F.left(F.when(safe == "", F.lit("document")).otherwise(safe), F.lit(MAX_STEM))


def output_name(jobs):
    """Result name of a job from its first input's name, kind and options."""
    c = F.col
    s = safe_stem(F.coalesce(c("first_name"), F.lit("document")))
    name = (
        F.when((c("kind") == "pdf_edit") & (c("edit_action") == "merge"), F.lit("merged.pdf"))
        .when(c("kind") == "pdf_edit", F.concat(s, F.lit("-edited.pdf")))
        .when((c("kind") == "ocr") & (c("ocr_output_format") == "text"), F.concat(s, F.lit("-ocr.txt")))
        .when(c("kind") == "ocr", F.concat(s, F.lit("-ocr.pdf")))
        .when((c("kind") == "office_convert") & (c("target") == "md"), F.concat(s, F.lit(".md")))
        .when(c("kind") == "extract_markdown", F.concat(s, F.lit(".md")))
        .when((c("kind") == "pdf_translate") & (c("output_mode") == "bilingual"), F.concat(s, F.lit("-bilingual.pdf")))
        .when(c("kind") == "pdf_translate", F.concat(s, F.lit("-translated.pdf")))
        .when((c("kind") == "image_to_pdf") & (c("n_inputs") > 1), F.lit("images.pdf"))
        .otherwise(F.concat(s, F.lit(".pdf")))
    )
    return jobs.withColumn("output_name", name)


def unsafe_name(col):
    return col.isNull() | col.isin("", ".", "..") | F.contains(col, F.lit("/"))


def safe_name_filter(files, max_files=C.MAX_FILES):
    """Verdict on the stored names of each job. Distinct names are counted in two
    combining steps."""
    per_name = files.groupBy("job_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_name.groupBy("job_id")
        .agg(
            F.sum("n").alias("n_files"),
            F.max("n").alias("_most"),
            F.sum(F.when(unsafe_name(F.col("name")), F.col("n")).otherwise(0)).alias("n_unsafe"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("n_files") > max_files, "too_many")
            .when(F.col("_most") > 1, "duplicate")
            .when(F.col("n_unsafe") > 0, "unsafe")
            .otherwise("ok"),
        )
        .drop("_most")
    )


def infer_route(files, choices, profile="native"):
    """Route of a batch without one: an enabled route that accepts every file and
    agrees with a chosen source or target; a PDF target first, then catalogue
    order. Relational division over the distinct suffixes of a job, so a job's size
    does not matter. ``choices``: job_id, source, target (NULL = free)."""
    spark = files.sparkSession
    exts = files.select("job_id", T.suffix(F.col("name")).alias("ext")).distinct()
    accept = C.accepts(spark, profile)
    routes = C.routes(spark, profile).select("route_no", F.col("source").alias("r_source"), F.col("target").alias("r_target"))
    wide = accept.join(routes, "route_no")
    need = exts.groupBy("job_id").agg(F.count(F.lit(1)).alias("_need"))
    cover = exts.join(F.broadcast(wide), "ext").groupBy("job_id", "route_no", "r_source", "r_target").agg(
        F.count(F.lit(1)).alias("_have")
    )
    fits = (
        cover.join(need, "job_id")
        .filter(F.col("_have") == F.col("_need"))
        .join(choices, "job_id")
        .filter(
            (F.col("source").isNull() | (F.col("source") == F.col("r_source")))
            & (F.col("target").isNull() | (F.col("target") == F.col("r_target")))
        )
    )
    best = fits.groupBy("job_id").agg(
        F.min(F.struct((F.col("r_target") != "pdf").alias("_p"), "route_no", "r_source", "r_target")).alias("_b")
    )
    return choices.select("job_id").join(best, "job_id", "left").select(
        "job_id", F.col("_b.route_no").alias("route_no"), F.col("_b.r_source").alias("source"), F.col("_b.r_target").alias("target")
    )
