"""Rectangles as columns x, y, w, h (lower left corner, y upwards)."""

from pyspark.sql import functions as F


def right(r=None):
    return F.col("x") + F.col("w") if r is None else r["x"] + r["w"]


def top(r=None):
    return F.col("y") + F.col("h") if r is None else r["y"] + r["h"]


def overlap_ratio(a, b):
    """Shared area over the smaller of the two areas; ``a`` and ``b`` are structs."""
    iw = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    ih = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    small = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(small > 0, iw * ih / small).otherwise(F.lit(0.0))


# About half a page: most boxes touch one to three cells.
CELL = 256.0


def cells(x, y, w, h, size=CELL):
    """Grid cells a box touches, as an array of structs. Boxes that overlap share
    at least one cell, so an equi-join on the cell finds every overlapping pair."""
    cols = F.sequence(F.floor(x / size), F.floor((x + w) / size))
    rows = F.sequence(F.floor(y / size), F.floor((y + h) / size))
    return F.flatten(
        F.transform(cols, lambda i: F.transform(rows, lambda j: F.struct(i.alias("cx"), j.alias("cy"))))
    )
