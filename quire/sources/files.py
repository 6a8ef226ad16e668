"""Reading inputs: inventories, whole texts, delimited text, JSON, XML, glossaries."""

import os
import re
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quire.functions import text as T
from quire.functions.json import whole_json


@F.pandas_udf(Ty.BooleanType())
def _is_link(paths: pd.Series) -> pd.Series:
    """Whether a ``file:`` path is a symbolic link; other stores have none."""
    return paths.map(lambda p: p.startswith("file:") and os.path.islink(unquote(urlparse(p).path)))


def _matched(spark, glob):
    """Whether a path matches ``glob`` itself and does not lie in a directory that does."""
    last = glob.rstrip("/").rsplit("/", 1)[-1]
    if not re.search(r"[*?\[{]", last) or re.search(r"\{[^{}]*/", glob):
        return F.lit(True)  # a directory by its name, or branches of different depths
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    depth = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).depth()
    return F.size(F.split(F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?", ""), "/")) - 1 == depth


def file_inventory(spark, glob):
    """path, name, ext, size, modified per regular file; the content column is pruned, so
    no bytes are read. Directories and hidden files never match, nor do files in a directory
    whose name matches; symbolic links are left out."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", bool(re.search(r"[*?\[{]", glob)))
        .load(glob)
        .filter(_matched(spark, glob))
        .filter(~_is_link("path"))
        .select(
            "path",
            F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
        )
        .withColumn("ext", T.suffix(F.col("name")))
    )


def decode_text(content, on_error="replace"):
    """UTF-8 bytes as text. ``replace`` puts U+FFFD for bad bytes, ``fail`` raises."""
    as_text = content.cast("string")
    return F.make_valid_utf8(as_text) if on_error == "replace" else F.validate_utf8(as_text)


def scan_text(spark, glob, on_error="replace", max_bytes=None):
    """One row per file. Too large files are dropped before their bytes are read."""
    raw = spark.read.format("binaryFile").load(glob)
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    return raw.select("path", F.col("length").alias("size"), decode_text(F.col("content"), on_error).alias("text"))


def scan_delimited(spark, path, sep=",", schema=None):
    """CSV / TSV with quoted separators, doubled quotes and embedded line breaks."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def odd_quotes(lines, key, value="value"):
    """Keys whose lines hold an odd number of quotes in all. Counted line by line
    and summed, so a large file is never held as one value."""
    quotes = F.length(value) - F.length(F.replace(F.col(value), F.lit('"'), F.lit("")))
    return lines.groupBy(key).agg(F.sum(quotes).alias("quotes")).filter(F.col("quotes") % 2 == 1)


def unclosed_quotes(spark, path):
    """Delimited files whose last quote is never closed."""
    return odd_quotes(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"), "path")


def normalize_json(col, on_error="keep"):
    """Parsed and written again with sorted keys. ``keep`` leaves bad text as it
    is, ``fail`` raises."""
    if on_error == "fail":
        return F.to_json(whole_json(col, fail=True))
    return F.coalesce(F.to_json(whole_json(col)), col)


def parse_xml(col, schema):
    """Row from XML text. External entities are never expanded: such a field, and
    text that does not parse, is NULL."""
    return F.from_xml(col, schema)


def scan_xml(spark, path, row_tag, schema=None):
    reader = spark.read.option("rowTag", row_tag).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).xml(path)


def scan_glossary(df, col="text", keep=()):
    """(source, target) per glossary line: split at the first ``,``, else ``=>``,
    else ``=``; a lone term maps to itself; blank lines are dropped."""
    line = T.strip(F.col("_line"))

    def cut(mark):
        at = F.instr(line, mark)
        return at, T.strip(line.substr(F.lit(1), at - 1)), T.strip(line.substr(at + len(mark), F.length(line)))

    comma, arrow, equal = cut(","), cut("=>"), cut("=")
    pick = lambda i: (
        F.when(comma[0] > 0, comma[i]).when(arrow[0] > 0, arrow[i]).when(equal[0] > 0, equal[i]).otherwise(line)
    )
    return (
        df.select(*keep, F.posexplode(F.split(F.col(col), "\r\n|\n|\r")).alias("line_no", "_line"))
        .filter(line != "")
        .select(*keep, "line_no", pick(1).alias("source_term"), pick(2).alias("target_term"))
    )
