"""Functions the user brings: processors, translators, recognisers, and the page
spec as a table function. Spark spreads the rows; only the call itself is Python.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


def _with_error(schema):
    return Ty.StructType(list(schema.fields) + [Ty.StructField("error", Ty.StringType())])


def map_documents(df, fn, schema, key="doc_id"):
    """``fn(row: dict) -> dict`` over every document; a failure becomes that row's
    ``error`` and stops nothing else. ``schema``: result fields beside the key."""
    out = Ty.StructType([df.schema[key]] + list(schema.fields))
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    got, error = fn(row), None
                except Exception as exc:  # noqa: BLE001
                    got, error = {}, f"{type(exc).__name__}: {exc}"
                rows.append([row[key], *(got.get(n) for n in names), error])
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    return df.mapInPandas(run, _with_error(out))


def translate_regions(batches, fn, keys, lanes=None):
    """``fn(items: list[(id, text)]) -> dict`` per batch, asked once more when ids are
    missing. A batch that fails or stays incomplete gives rows with ``error``; the
    others go on. ``lanes`` bounds how many batches run at a time; ``batches``: keys
    and ``items`` array<struct<id,text>>."""
    if lanes:
        batches = batches.repartition(lanes)
    out = Ty.StructType(
        [batches.schema[k] for k in keys]
        + [Ty.StructField("id", Ty.StringType()), Ty.StructField("translation", Ty.StringType()),
           Ty.StructField("attempts", Ty.LongType()), Ty.StructField("error", Ty.StringType())]
    )

    def run(parts):
        for pdf in parts:
            rows = []
            for row in pdf.to_dict("records"):
                items = [(i["id"], i["text"]) for i in row["items"]]
                got, error, tries = {}, None, 0
                try:
                    while tries < 2 and any(i not in got for i, _ in items):
                        tries += 1
                        got = fn(items, tries)
                    if any(i not in got for i, _ in items):
                        error = "incomplete"
                except Exception as exc:  # noqa: BLE001
                    error = f"{type(exc).__name__}: {exc}"
                head = [row[k] for k in keys]
                rows += [[*head, i, None if error else got[i], tries, error] for i, _ in items]
            yield pd.DataFrame(rows, columns=[f.name for f in out.fields])

    return batches.select(*keys, "items").mapInPandas(run, out)


OBSERVATION = Ty.StructType(
    [Ty.StructField("item_no", Ty.LongType()), Ty.StructField("text", Ty.StringType())]
    + [Ty.StructField(n, Ty.DoubleType()) for n in ("nx", "ny", "nw", "nh", "confidence")]
)


def recognize_pages(images, fn, keys):
    """``fn(content: bytes) -> [(text, nx, ny, nw, nh, confidence)]`` per page image.
    Filter to the pages that need it first: nothing is skipped in here."""
    out = Ty.StructType([images.schema[k] for k in keys] + list(OBSERVATION.fields) + [Ty.StructField("error", Ty.StringType())])
    blank = [None] * 7

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                head = [row[k] for k in keys]
                try:
                    rows += [[*head, n, *found, None] for n, found in enumerate(fn(bytes(row["content"])))]
                except Exception as exc:  # noqa: BLE001
                    rows.append([*head, *blank, f"{type(exc).__name__}: {exc}"])
            yield pd.DataFrame(rows, columns=[f.name for f in out.fields])

    return images.select(*keys, "content").mapInPandas(run, out)


PAGE_ROW = Ty.StructType([Ty.StructField("pos", Ty.LongType()), Ty.StructField("page_no", Ty.LongType())])


class PageSpec:
    """``page_spec(spec, n_pages, mode)`` for SQL users: mode ``select`` gives sorted
    distinct pages, ``order`` keeps the written order and repeats."""

    def eval(self, spec: str, n_pages: int, mode: str):
        runs = []
        for part in (p.strip() for p in (spec or "").split(",")):
            if not part:
                continue
            left, dash, right = part.partition("-")
            if dash:
                runs.append((int(left) if left else 1, int(right) if right else n_pages))
            else:
                runs.append((int(left), int(left)))
        if mode == "select":
            if not runs:
                runs = [(1, n_pages)] if not (spec or "").strip() else []
            # Overlapping runs are swept in order, so a page is named once.
            reached = pos = 0
            for lo, hi in sorted((min(r), max(r)) for r in runs):
                for page in range(max(lo, reached + 1), min(hi, n_pages) + 1):
                    yield pos, page
                    pos += 1
                reached = max(reached, min(hi, n_pages))
        else:
            pos = 0
            for a, b in runs:
                if a <= b:
                    walk = range(max(a, 1), min(b, n_pages) + 1)
                else:
                    walk = range(min(a, n_pages), max(b, 1) - 1, -1)
                for page in walk:
                    yield pos, page
                    pos += 1


def register_page_spec(spark, name="page_spec"):
    spark.udtf.register(name, F.udtf(PageSpec, returnType=PAGE_ROW))
    return name
