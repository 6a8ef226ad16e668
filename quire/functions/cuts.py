"""Reading order of many pages at once, by cuts along clear gaps.

All boxes of a batch are columns of one table. A *segment* is a set of boxes of one page that
no cut has parted yet; it is known by the first place its boxes will take in the result.
A level cuts all open segments together: sort them by near edge, take the running maximum
of the far edge, and a gap is where the next near edge lies beyond it. A segment with column
gaps is cut at all of them (a cut at one leaves the others as they are, so their order of
size does not matter); one without is cut at its widest band gap alone, because its parts
may have columns of their own. Segments without a gap are settled and leave the table.
"""

import numpy as np

COLUMN_GAP, BAND_GAP, LEVEL = 4.0, 2.0, 2.0


def _running_max(values, group):
    """Maximum of the values so far within each run of equal ``group`` numbers; exact, by ranks."""
    known, rank = np.unique(values, return_inverse=True)
    step = np.cumsum(np.diff(group, prepend=group[:1]) != 0) * len(known)
    return known[np.maximum.accumulate(rank + step) - step]


def _gaps(segment, near, size):
    """Boxes sorted by segment and near edge; first box of each segment; the gap before each box."""
    order = np.lexsort((near, segment))
    seg, lo = segment[order], near[order]
    first = np.diff(seg, prepend=-1) != 0
    reach = _running_max(lo + size[order], seg)
    gap = np.full(len(lo), -np.inf)
    gap[1:] = lo[1:] - reach[:-1]
    gap[first] = -np.inf
    return order, first, gap


def _count_within(flags, first):
    """Running number of flags inside each segment."""
    total = np.cumsum(flags)
    start = np.flatnonzero(first)
    return total - np.repeat(total[start] - flags[start], np.diff(np.append(start, len(flags))))


def _parts(segment, near, size, least, widest_only):
    """Number of cuts before each box inside its segment."""
    order, first, gap = _gaps(segment, near, size)
    cut = gap > least
    if widest_only:
        start = np.flatnonzero(first)
        most = np.repeat(np.maximum.reduceat(gap, start), np.diff(np.append(start, len(gap))))
        cut &= gap == most
        cut &= _count_within(cut, first) == 1
    out = np.empty(len(near), np.int64)
    out[order] = _count_within(cut, first)
    return out


def _moved(segment, part):
    """First place of each box's new segment, parts in order."""
    order = np.lexsort((part, segment))
    seg, p = segment[order], part[order]
    new = (np.diff(seg, prepend=-1) != 0) | (np.diff(p, prepend=-1) != 0)
    start = np.flatnonzero(new)
    # places before a part are those of its segment and of the parts before it
    whole = np.flatnonzero(np.diff(seg, prepend=-1) != 0)
    base = seg - np.repeat(whole, np.diff(np.append(whole, len(seg))))
    out = np.empty(len(seg), np.int64)
    out[order] = base + np.repeat(start, np.diff(np.append(start, len(seg))))
    return out


def reading_places(page, x, y, w, h, tie):
    """Place (from 0, over all pages in their order) of each box; ``y`` grows upwards.

    Columns before bands, left before right, upper before lower. Boxes that no cut parts go
    by top edge; tops that follow each other within ``LEVEL`` are one line, which goes by left
    edge, then ``tie``.
    """
    segment = _moved(np.zeros(len(x), np.int64), page)
    todo = np.arange(len(x))
    while len(todo):
        seg = segment[todo]
        part = _parts(seg, x[todo], w[todo], COLUMN_GAP, False)
        columns = np.zeros(len(x), bool)
        columns[seg[part > 0]] = True
        rest = np.flatnonzero(~columns[seg])
        if len(rest):
            # upper bands first
            part[rest] = -_parts(seg[rest], y[todo[rest]], h[todo[rest]], BAND_GAP, True)
        cut = np.zeros(len(x), bool)
        cut[seg[part != 0]] = True
        going = cut[seg]
        todo, part = todo[going], part[going]
        if len(todo):
            segment[todo] = _moved(segment[todo], part)
    top = y + h
    order = np.lexsort((-top, segment))
    new = np.diff(segment[order], prepend=-1) != 0
    line = np.cumsum(new | (-np.diff(top[order], prepend=np.inf) > LEVEL))
    row = np.empty(len(x), np.int64)
    row[order] = line
    places = np.empty(len(x), np.int64)
    places[np.lexsort((tie, x, row))] = np.arange(len(x))
    return places
