"""Text helpers as column expressions (characters are code points throughout)."""

import unicodedata

from pyspark.sql import functions as F


def _accent_pairs():
    """Lower-case letters that Unicode composes of one letter and marks, of any script."""
    src, dst = [], []
    for code in range(0x00C0, 0x2000):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if ch == ch.lower() and len(parts) > 1 and all(unicodedata.category(m) == "Mn" for m in parts[1:]):
            src.append(ch)
            dst.append(parts[0])
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_pairs()
MARKS = r"\p{Mn}+"


def fold_letters(col):
    """Lower case, composed letters without their accents; one character stays one character
    (a dotted capital I would become two)."""
    low = F.lower(F.replace(col, F.lit("İ"), F.lit("i")))
    # Character mapping is the slow part; plain ASCII texts skip it.
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, ACCENTED, PLAIN)).otherwise(low)


def fold_case_accents(col):
    """Lower case without accents, whether composed with their letters or not."""
    return F.regexp_replace(fold_letters(col), MARKS, "")


def fold_python(value):
    """The same folding for a query literal."""
    low = value.replace("İ", "i").lower().translate(dict(zip(map(ord, ACCENTED), PLAIN)))
    return "".join(ch for ch in low if unicodedata.category(ch) != "Mn")


# White space and punctuation dropped when texts are compared: a fixed pattern.
FOLD_DROP = r"[\s\p{Z}\p{P}]"


def fold_text(col):
    """Case, accents, white space and punctuation removed; sharp s counts as ss."""
    return F.regexp_replace(F.replace(fold_case_accents(col), F.lit("ß"), F.lit("ss")), FOLD_DROP, "")


def strip(col):
    """Trim spaces, tabs and line breaks on both sides."""
    return F.btrim(col, F.lit(" \t\r\n"))


def collapse(col):
    """Runs of white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(col, r"[ \t\r\n]+", " "))


def escape_html(col, quotes=True):
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    if quotes:
        out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    return out


def escape_markdown(col):
    return F.regexp_replace(col, r"([\\`*_\[\]])", r"\\$1")


def suffix(name):
    """Extension with its dot, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]+)$", 1))


def stem(name):
    """Name without its last extension."""
    return F.regexp_replace(name, r"(?<=[^./])\.[^./]+$", "")
