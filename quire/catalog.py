"""Formats, routes, requirements and option keys as small literal tables.

All of them are fixed lists (at most 64 rows), so broadcasting them is bounded by
construction.
"""

# Known formats per profile and the extensions they accept.
FORMATS_WEB = [
    ("pdf", "PDF", ".pdf"),
    ("word", "Word", ".doc,.docx"),
    ("ppt", "PPT", ".ppt,.pptx"),
    ("excel", "Excel", ".xls,.xlsx"),
    ("md", "Markdown", ".md,.markdown"),
    ("html", "HTML", ".html,.htm"),
    ("image", "Image", ".png,.jpg,.jpeg,.webp,.tif,.tiff"),
    ("data", "Data", ".txt,.text,.csv,.json,.xml,.yaml,.yml,.zip,.epub"),
    ("translated_pdf", "Translated PDF", ".pdf"),
    ("ocr", "OCR", ".pdf,.png,.jpg,.jpeg,.webp,.tif,.tiff"),
]
# Fixed value: archives are accepted as data except when the target is a PDF.
DATA_TO_PDF_WEB = ".txt,.text,.csv,.json,.xml,.yaml,.yml"
FORMATS_NATIVE = [
    ("pdf", "PDF", ".pdf"),
    ("word", "Word", ".doc,.docx"),
    ("translated_pdf", "Translated PDF", ".pdf"),
    ("ocr", "OCR", ".pdf,.png,.jpg,.jpeg,.tiff,.heic"),
    ("ppt", "PPT", ".ppt,.pptx"),
    ("excel", "Excel", ".xls,.xlsx"),
    ("md", "Markdown", ".md,.markdown,.txt"),
    ("html", "HTML", ".html,.htm"),
    ("image", "Image", ".png,.jpg,.jpeg,.webp,.tif,.tiff,.heic"),
    ("data", "Data", ".txt,.text,.csv,.tsv,.json,.xml,.yaml,.yml"),
]

# Routes in catalogue order: source, target, kind, engines in order
# of preference, requirements as name:level.
ROUTES_WEB = [
    ("pdf", "translated_pdf", "pdf_translate", "babeldoc,builtin_translate", "deepseek:required,babeldoc:optional"),
    ("pdf", "ocr", "ocr", "ocrmypdf_ocr,tesseract_ocr", "tesseract:required,ocrmypdf:optional"),
    ("image", "ocr", "ocr", "tesseract_ocr", "tesseract:required"),
    ("pdf", "md", "extract_markdown", "markitdown,tesseract_ocr", "markitdown:one-of-markdown,tesseract:one-of-markdown"),
    ("image", "md", "extract_markdown", "tesseract_ocr", "tesseract:required"),
    ("pdf", "pdf", "pdf_edit", "pdf_editor", ""),
    ("word", "pdf", "convert", "libreoffice_pdf", "libreoffice:required"),
    ("ppt", "pdf", "convert", "libreoffice_pdf", "libreoffice:required"),
    ("excel", "pdf", "convert", "libreoffice_pdf", "libreoffice:required"),
    ("md", "pdf", "convert", "browser_pdf", "playwright:required"),
    ("html", "pdf", "convert", "browser_pdf", "playwright:required"),
    ("image", "pdf", "convert", "image_pdf", ""),
    ("data", "pdf", "convert", "browser_pdf", "playwright:required"),
    ("word", "md", "extract_markdown", "markitdown", "markitdown:required"),
    ("ppt", "md", "extract_markdown", "markitdown", "markitdown:required"),
    ("excel", "md", "extract_markdown", "markitdown", "markitdown:required"),
    ("data", "md", "extract_markdown", "markitdown", "markitdown:required"),
    ("html", "md", "extract_markdown", "markitdown", "markitdown:required"),
]
ROUTES_NATIVE = [
    ("word", "pdf", "office_convert", "", "libreoffice:required"),
    ("word", "md", "office_convert", "", "libreoffice:required"),
    ("ppt", "pdf", "office_convert", "", "libreoffice:required"),
    ("ppt", "md", "office_convert", "", "libreoffice:required"),
    ("excel", "pdf", "office_convert", "", "libreoffice:required"),
    ("excel", "md", "office_convert", "", "libreoffice:required"),
    ("html", "md", "extract_markdown", "", ""),
    ("data", "md", "extract_markdown", "", ""),
    ("pdf", "pdf", "pdf_edit", "", ""),
    ("pdf", "translated_pdf", "pdf_translate", "", "deepseek:required"),
    ("pdf", "ocr", "ocr", "", ""),
    ("image", "ocr", "ocr", "", ""),
    ("pdf", "md", "extract_markdown", "", ""),
    ("image", "md", "extract_markdown", "", ""),
    ("image", "pdf", "image_to_pdf", "", ""),
    ("md", "pdf", "text_to_pdf", "", ""),
    ("html", "pdf", "text_to_pdf", "", ""),
    ("data", "pdf", "text_to_pdf", "", ""),
]

# Dependency name, category, risk.
DEPENDENCIES = [
    ("pymupdf", "core", "license_sensitive"),
    ("pillow", "core", "low"),
    ("libreoffice", "external_tool", "heavy"),
    ("playwright", "external_tool", "heavy"),
    ("markitdown", "optional", "heavy"),
    ("tesseract", "external_tool", "heavy"),
    ("ocrmypdf", "optional", "heavy"),
    ("babeldoc", "optional", "heavy"),
    ("deepseek", "optional", "low"),
    ("openai", "optional", "low"),
]
# Engine, its dependencies in order, its licence note.
ENGINES = [
    ("libreoffice_pdf", "libreoffice", "Office tool called as a command."),
    ("browser_pdf", "playwright", "Browser is an external runtime."),
    ("image_pdf", "pillow", "Image library installed as a package."),
    ("markitdown", "markitdown", "Extractor is an optional package."),
    ("tesseract_ocr", "tesseract,pymupdf", "OCR engine called locally."),
    ("ocrmypdf_ocr", "ocrmypdf,tesseract", "OCR tool called as a command."),
    ("pdf_editor", "pymupdf", "PDF library installed as a package."),
    ("babeldoc", "babeldoc", "Layout engine is optional."),
    ("builtin_translate", "pymupdf", "Fallback built on the PDF library."),
]

# Option defaults, and the option keys each kind of job keeps.
OPTION_DEFAULTS = [
    ("provider", "deepseek"),
    ("output_mode", "preserve_layout"),
    ("source_language", "auto"),
    ("target_language", "zh"),
    ("glossary", ""),
    ("edit_action", "edit"),
    ("delete_pages", ""),
    ("rotate_pages", ""),
    ("rotate_degrees", "90"),
    ("reorder_pages", ""),
    ("crop_pages", ""),
    ("crop_box", ""),
    ("watermark", ""),
    ("replace_find", ""),
    ("replace_with", ""),
    ("ocr_language", "zh-Hans,en-US"),
    ("ocr_output_format", "searchable_pdf"),
]
OPTION_KEYS = {
    "pdf_translate": ["provider", "output_mode", "source_language", "target_language", "glossary", "ocr_language"],
    "pdf_edit": [
        "edit_action", "delete_pages", "rotate_pages", "rotate_degrees", "reorder_pages",
        "crop_pages", "crop_box", "watermark", "replace_find", "replace_with",
    ],
    "ocr": ["ocr_language", "ocr_output_format"],
    "extract_markdown": ["ocr_language"],
}

# Size and count limits.
MB = 1024 * 1024
WEB_UPLOAD_LIMIT = 200 * MB
WEB_TEXT_LIMIT = 25 * MB
NATIVE_UPLOAD_LIMIT = 250 * MB
NATIVE_TEXT_LIMIT = 20 * MB
MAX_FILES = 256
MAX_PAGES = 200
MAX_CHARS = 200_000


def formats(profile):
    return FORMATS_WEB if profile == "web" else FORMATS_NATIVE


def route_rows(profile):
    """(route_no, source, target, kind, engines, requirements, accept, input_limit)."""
    accepts = {name: exts for name, _, exts in formats(profile)}
    rows = []
    for i, (source, target, kind, engines, needs) in enumerate(
        ROUTES_WEB if profile == "web" else ROUTES_NATIVE
    ):
        accept = accepts[source]
        if profile == "web":
            limit = WEB_UPLOAD_LIMIT
            if source == "data" and target == "pdf":
                accept = DATA_TO_PDF_WEB
        else:
            textual = kind in ("text_to_pdf", "extract_markdown") and source in ("md", "html", "data")
            limit = NATIVE_TEXT_LIMIT if textual else NATIVE_UPLOAD_LIMIT
        rows.append((i, source, target, kind, engines, needs, accept, limit))
    return rows


ROUTE_COLUMNS = ["route_no", "source", "target", "kind", "engines", "requirements", "accept", "input_limit"]


def accept_rows(profile):
    return [(r[0], ext) for r in route_rows(profile) for ext in r[6].split(",")]


def requirement_rows(profile):
    out = []
    for r in route_rows(profile):
        for pos, item in enumerate(p for p in r[5].split(",") if p):
            name, level = item.split(":")
            out.append((r[0], pos, name, level))
    return out


def engine_rows():
    """(engine, position, dependency, note)."""
    return [(e, i, d, note) for e, deps, note in ENGINES for i, d in enumerate(deps.split(","))]


def literal_table(spark, schema, rows):
    """A small fixed table as a local relation: the planner sees its size, and no
    Python rows or extra tasks are involved. ``schema``: "name type, …"."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, (bool, int)):
            return str(v)
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    names = ", ".join(n for n, _ in fields)
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {cast} FROM VALUES {body} AS t({names})")


def routes(spark, profile="native"):
    return literal_table(
        spark,
        "route_no bigint, source string, target string, kind string, engines string, "
        "requirements string, accept string, input_limit bigint",
        route_rows(profile),
    )


def accepts(spark, profile="native"):
    return literal_table(spark, "route_no bigint, ext string", accept_rows(profile))


def format_table(spark, profile="native"):
    return literal_table(spark, "format string, label string, input string", formats(profile))


def requirements(spark, profile="web"):
    return literal_table(
        spark, "route_no bigint, pos int, dependency string, level string", requirement_rows(profile)
    )


def engines(spark):
    return literal_table(spark, "engine string, dep_pos int, dependency string, note string", engine_rows())


def dependencies(spark):
    return literal_table(spark, "dependency string, category string, risk string", DEPENDENCIES)
