"""Page specifications as column expressions.

A selection is a handful of (lo, hi) ranges, so selecting, deleting, reordering and
renumbering pages is arithmetic: a page's new number follows from its old number,
the ranges and the page count. No window, no shuffle.

A spec may be a Python string (one for the whole corpus) or a Column (one per row).
A string is cut up here and unrolled into plain arithmetic, which stays inside
generated code; a Column is handled by array functions.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "array<struct<lo:bigint,hi:bigint>>"


def _long(v):
    return F.lit(v).cast("bigint")


def _literal_parts(spec):
    """(a, b) per part as written; None for an open end. Bad numbers raise."""
    out = []
    for part in (p.strip() for p in spec.split(",")):
        if part:
            left, dash, right = part.partition("-")
            a = int(left) if left.strip() else None
            b = (int(right) if right.strip() else None) if dash else a
            out.append((a, b, bool(dash)))
    return out


def _parts(spec):
    return F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")


def _bounds(part, n):
    """(lo, hi) of one part as written; an open end becomes 1 or ``n``."""
    dash = F.instr(part, "-")
    left = F.trim(F.substring_index(part, "-", 1))
    right = F.trim(part.substr(dash + 1, F.length(part)))
    one = part.try_cast("bigint")
    a = F.when(dash == 0, one).when(left == "", _long(1)).otherwise(left.try_cast("bigint"))
    b = F.when(dash == 0, one).when(right == "", n.cast("bigint")).otherwise(right.try_cast("bigint"))
    return F.struct(a.alias("lo"), b.alias("hi"))


def is_blank(spec):
    if isinstance(spec, Column):
        return F.coalesce(F.trim(spec), F.lit("")) == ""
    return F.lit(not spec.strip())


class _Unrolled:
    """Selection of a string spec: one term of plain arithmetic per part."""

    def __init__(self, spec, n):
        n = n.cast("bigint")
        parts = _literal_parts(spec)
        if not parts and not spec.strip():
            parts = [(1, None, True)]
        ranges = []
        for a, b, dash in parts:
            lo = 1 if a is None else a
            if dash and b is None:
                # An open end below its start swaps: the last page is meant.
                ranges.append((lo, F.greatest(F.least(_long(lo), n), _long(1)), n))
            else:
                lo, hi = min(lo, b), max(lo, b)
                ranges.append((lo, _long(max(lo, 1)), F.least(_long(hi), n)))
        # Sorted by the written start, which is also the order after clipping.
        self.ranges = [(lo, hi) for _, lo, hi in sorted(ranges, key=lambda r: r[0])]
        self.n = n

    def contains(self, page):
        hit = F.lit(False)
        for lo, hi in self.ranges:
            hit = hit | ((page >= lo) & (page <= hi))
        return hit

    def rank(self, page):
        """How many selected pages are <= ``page``: ranges are swept in order, each
        counting only what lies beyond the reach of those before it."""
        total, reach = _long(0), _long(0)
        for lo, hi in self.ranges:
            first = F.greatest(lo, reach + 1)
            total = total + F.greatest(_long(0), F.least(page, hi) - first + 1)
            reach = F.greatest(reach, F.when(lo <= hi, hi).otherwise(_long(0)))
        return total

    def total(self):
        return self.rank(self.n)


class _PerRow:
    """Selection of a Column spec, as merged disjoint ranges."""

    def __init__(self, spec, n):
        n = n.cast("bigint")
        clamp = F.transform(
            F.transform(_parts(spec), lambda p: _bounds(p, n)),
            lambda r: F.struct(
                F.greatest(F.least(r["lo"], r["hi"]), _long(1)).alias("lo"),
                F.least(F.greatest(r["lo"], r["hi"]), n).alias("hi"),
            ),
        )
        kept = F.sort_array(F.filter(clamp, lambda r: r["lo"] <= r["hi"]))

        def add(acc, r):
            last = F.element_at(acc, -1)
            joined = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))
            return (
                F.when(F.size(acc) == 0, F.array(r))
                .when(r["lo"] > last["hi"] + 1, F.concat(acc, F.array(r)))
                .otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined)))
            )

        every = F.array(F.struct(_long(1).alias("lo"), n.alias("hi")))
        merged = F.aggregate(kept, F.array().cast(RANGE), add)
        self.ranges = F.when(is_blank(spec), every).otherwise(merged)
        self.n = n

    def contains(self, page):
        return F.exists(self.ranges, lambda r: (page >= r["lo"]) & (page <= r["hi"]))

    def rank(self, page):
        return F.aggregate(
            self.ranges,
            _long(0),
            lambda s, r: s + F.greatest(_long(0), F.least(page, r["hi"]) - r["lo"] + 1),
        )

    def total(self):
        return self.rank(self.n)


def selection(spec, n):
    """Lenient selection: open ends, swapped bounds, clamped to 1..n; blank = all.
    Gives ``contains(page)``, ``rank(page)`` and ``total()``."""
    return _PerRow(spec, n) if isinstance(spec, Column) else _Unrolled(spec, n)


ORDERED = "array<struct<a:bigint,b:bigint,off:bigint>>"


class _UnrolledOrder:
    def __init__(self, spec, n):
        n, off, self.runs = n.cast("bigint"), _long(0), []
        for a, b, dash in _literal_parts(spec):
            a = _long(1 if a is None else a)
            b = n if dash and b is None else _long(b)
            up = a <= b
            lo = F.when(up, F.greatest(a, _long(1))).otherwise(F.greatest(b, _long(1)))
            hi = F.when(up, F.least(b, n)).otherwise(F.least(a, n))
            size = F.greatest(_long(0), hi - lo + 1)
            self.runs.append((lo, hi, up, off))
            off = off + size
        self.size = off

    def total(self):
        return self.size

    def positions(self, page):
        hits = [
            F.when(
                (page >= lo) & (page <= hi), off + F.when(up, page - lo).otherwise(hi - page) + 1
            )
            for lo, hi, up, off in self.runs
        ]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<bigint>")


class _PerRowOrder:
    def __init__(self, spec, n):
        n = n.cast("bigint")
        clipped = F.transform(
            F.transform(_parts(spec), lambda p: _bounds(p, n)),
            lambda r: F.when(
                r["lo"] <= r["hi"],
                F.struct(F.greatest(r["lo"], _long(1)).alias("a"), F.least(r["hi"], n).alias("b"), F.lit(True).alias("up")),
            ).otherwise(
                F.struct(F.least(r["lo"], n).alias("a"), F.greatest(r["hi"], _long(1)).alias("b"), F.lit(False).alias("up"))
            ),
        )
        live = F.filter(clipped, lambda r: F.when(r["up"], r["a"] <= r["b"]).otherwise(r["a"] >= r["b"]))

        def end_of(acc):
            last = F.element_at(acc, -1)
            return F.when(F.size(acc) == 0, _long(0)).otherwise(last["off"] + F.abs(last["b"] - last["a"]) + 1)

        self.runs = F.aggregate(
            live,
            F.array().cast(ORDERED),
            lambda acc, r: F.concat(
                acc, F.array(F.struct(r["a"].alias("a"), r["b"].alias("b"), end_of(acc).alias("off")))
            ),
        )

    def total(self):
        return F.aggregate(self.runs, _long(0), lambda s, r: s + F.abs(r["b"] - r["a"]) + 1)

    def positions(self, page):
        hit = F.filter(
            self.runs, lambda r: (page >= F.least(r["a"], r["b"])) & (page <= F.greatest(r["a"], r["b"]))
        )
        return F.transform(hit, lambda r: r["off"] + F.abs(page - r["a"]) + 1)


def ordering(spec, n):
    """Order-preserving spec, clipped to 1..n; runs may descend, pages may repeat.
    Gives ``total()`` and ``positions(page)``, every new number of a page."""
    return _PerRowOrder(spec, n) if isinstance(spec, Column) else _UnrolledOrder(spec, n)


def lenient_error(spec):
    """True where a Column spec has a part that is not a page or a range. Such a
    part selects nothing; a string spec raises instead."""
    return ~F.forall(_parts(spec), lambda p: p.rlike(r"^(\+?[0-9]+|(\+?[0-9]+)? *- *(\+?[0-9]+)?)$"))


STRICT_PART = r"^\+?[0-9]+(-\+?[0-9]+)?$"


def strict_ranges(spec):
    """Ranges of a strict spec as written; blank gives an empty list."""
    parts = F.transform(F.split(F.trim(spec), ","), lambda p: F.trim(p))

    def one(p):
        return F.struct(
            F.substring_index(p, "-", 1).try_cast("bigint").alias("lo"),
            F.substring_index(p, "-", -1).try_cast("bigint").alias("hi"),
        )

    return F.when(is_blank(spec), F.array().cast(RANGE)).otherwise(F.transform(parts, one))


def strict_error(spec, n):
    """NULL when fine, else ``syntax`` or ``out_of_range``."""
    parts = F.transform(F.split(F.trim(spec), ","), lambda p: F.trim(p))
    ranges = strict_ranges(spec)
    bad_shape = ~F.forall(parts, lambda p: p.rlike(STRICT_PART))
    bad_order = F.exists(ranges, lambda r: F.coalesce(r["lo"] > r["hi"], F.lit(True)))
    outside = F.exists(ranges, lambda r: (r["lo"] < 1) | (r["hi"] > n))
    return (
        F.when(is_blank(spec), F.lit(None).cast("string"))
        .when(bad_shape | bad_order, F.lit("syntax"))
        .when(outside, F.lit("out_of_range"))
    )


def strict_pages(spec, n):
    """Pages in written order, duplicates kept; NULL when the spec is in error.
    The range check comes first, so a run is never longer than the document."""
    pages = F.flatten(F.transform(strict_ranges(spec), lambda r: F.sequence(r["lo"], r["hi"])))
    return F.when(strict_error(spec, n).isNull(), pages)
