"""Fill-in-middle: prefix, middle and suffix of a text by counted regular expressions.

A *unit* is one code point, ``(?s:.)``. ``regexp_count`` gives a text's number of units
``n`` (whole blocks of ``BLOCK`` units first, then what is left, so a long text never becomes
one string per unit). Two hash numbers of the document pick two cuts ``a <= b`` in
``0 .. n``. The row's own pattern ``\\A(unit{a}+)(unit{b-a}+)(unit*+)\\z`` has possessive
groups: it never backtracks, and one match captures all three pieces, which the replacement
string puts into order (``$n`` inserts a piece as it is, whatever signs it holds).

Texts that hold a marker stay plain, so each marker stands once in an arranged text and
``restore`` splits at the markers. (A marker begins with ``<`` and ends with ``>``: no piece
can complete one across a seam.)

All columns are expressions of the row: one scan, no shuffle, no Python. Nulls: a null text
is empty and plain; a null ``doc_id`` is hashed as an empty string. A text of any length is
cut as a whole. Repeated rows are cut alike. Only ``doc_id`` and ``text`` are read, so extra
columns cannot clash; an empty table gives no rows.
"""

from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "(?s:.)"
BLOCK = 1024


def unit_count(text):
    """Number of code points of ``text``, by counting matches."""
    block = F.lit(f"{UNIT}{{{BLOCK}}}")
    whole = F.when(F.length(text) >= BLOCK, F.regexp_count(text, block)).otherwise(F.lit(0))
    rest = F.when(F.length(text) >= BLOCK, F.regexp_replace(text, block, F.lit(""))).otherwise(text)
    return (whole * BLOCK + F.regexp_count(rest, F.lit(UNIT))).cast("long")


def _draws(doc_id, seed):
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs, seed=1, rate=90, spm=20):
    """``doc_id, text, n, form, prefix_chars, middle_chars, output`` for every row.

    ``rate`` percent of the documents are cut, ``spm`` percent of these with the suffix first.
    """
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", unit_count(F.col("text")))
    text, n = F.col("text"), F.col("n")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((n == 0) | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    cuts = F.array_sort(F.array(h1 % (n + 1), h2 % (n + 1)))
    rows = rows.withColumn("form", form).withColumn("cuts", F.when(F.col("form") != "plain", cuts))
    a, b = F.col("cuts")[0], F.col("cuts")[1]
    rows = rows.select("doc_id", "text", "n", "form", a.alias("prefix_chars"), (b - a).alias("middle_chars"))
    pattern = F.concat(
        F.lit(rf"\A({UNIT}{{"), F.col("prefix_chars"), F.lit(rf"}}+)({UNIT}{{"), F.col("middle_chars"), F.lit(rf"}}+)({UNIT}*+)\z")
    )
    order = F.when(F.col("form") == "spm", F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")).otherwise(F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"))
    arranged = F.when(F.col("form") == "plain", text).otherwise(F.regexp_replace(text, pattern, order))
    return rows.withColumn("output", arranged)


def restore(output, form):
    """The text that ``output`` was made from, by its markers."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
