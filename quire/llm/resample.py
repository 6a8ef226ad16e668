"""Target-distribution importance resampling: hashed n-gram weights, noise, exact selection.

*Weights.* Features are all runs of one and two consecutive words; each falls into one of
``BUCKETS`` buckets by the CRC of its UTF-8 bytes. Bucket counts of the raw and the target
texts (all rows, pre-aggregated on the map side) give one array of gains, which is as long as
the number of buckets whatever the corpus holds. CRCs are taken for all words of a few
megabytes of text at once: CRC-32 is linear, so a word's is the exclusive or of one table entry
per byte, and a pair's follows from those of its words. A document's weight is the floored mean of
the gains its features point to; a Gumbel noise drawn from a hash of ``doc_id`` turns the
highest sums into a draw without replacement.

*Selection.* The cutoff key, the ``k``-th best of the eligible rows, is found by weighted
median of medians. Every partition reports, for the rows on either side of the current pivot
that are still open, their number and the median of its batches' medians (weighted by their
sizes); the weighted median of what the partitions report is the next pivot, so each round
discards a guaranteed share (an eighth) of the open rows, and about half in practice, until
the pivot *is* the cutoff. Rounds send one row per partition to the driver: numbers, no keys
of documents. Once an eighth of a table is left, the open rows are written anew, so all rounds
together read little more than the first. Winners alone are sorted, score by score.

Keys are (score, ``doc_id``, row): better is a higher score, then a smaller ``doc_id``
(null last), then an earlier row of the scored table, so repeated rows are ranked one after
the other. Nulls: a null text has no words; a null ``doc_id`` is hashed as an empty
string. Texts of any length count whole. Only ``doc_id`` and ``text`` are read, so extra
columns cannot clash. Empty tables give no rows, an empty target counts as zero everywhere.
"""

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions.scale import number_rows
from quire.llm.common import stored
from quire.llm.words import Batch, slices

BUCKETS = 10_000
#: Bytes of words: digits, letters and everything beyond ASCII.
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False
#: Longer words (bytes) are summed one by one.
_LONG = 64
KEY = "score long, no_id long, id long, row long"
REPORT = "place long, n long, score long, no_id long, id long, row long"


@functools.cache
def _crc_tables():
    """CRC-32 is linear: what a byte adds ``d`` steps before the end, and a register moved ``d`` steps on."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
    step = lambda reg: one[reg & 255] ^ (reg >> 8)
    adds, moved = [one], [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(_LONG + 1):
        adds.append(step(adds[-1]))
        moved.append(step(moved[-1]))
    return np.array(adds), np.array(moved)


def _move(register, steps):
    """Each register after ``steps`` zero bytes."""
    _, moved = _crc_tables()
    return functools.reduce(np.bitwise_xor, (moved[steps, k, (register >> np.uint32(8 * k)) & 255] for k in range(4)))


def feature_codes(batch):
    """CRC-32 of every word of a ``Batch``, and of every word with the word after it.

    The second array has no meaning at the last word of a text.
    """
    adds, _ = _crc_tables()
    size = batch.end - batch.start
    short = np.minimum(size, _LONG)
    ones = np.uint32(0xFFFFFFFF)
    inner = np.zeros(len(size), np.uint32)
    if len(size):
        # bytes of all words side by side, with their distances to the ends of the words
        begin = np.cumsum(short) - short
        place = np.arange(int(short.sum())) - np.repeat(begin, short)
        letter = batch.buf[np.repeat(batch.start, short) + place]
        inner = np.bitwise_xor.reduceat(adds[np.repeat(short, short) - 1 - place, letter], begin)
    word = _move(np.full(len(size), ones), short) ^ inner
    pair = np.zeros(len(size), np.uint32)
    pair[:-1] = _move(word[:-1], short[1:] + 1) ^ adds[short[1:], 32] ^ inner[1:]
    word, pair = word ^ ones, pair ^ ones
    for i in np.flatnonzero(size > _LONG):
        word[i] = zlib.crc32(batch.word(i))
    for i in np.flatnonzero(size > _LONG):
        if i:
            pair[i - 1] = zlib.crc32(b" " + batch.word(i), int(word[i - 1]))
        if i + 1 < len(size):
            pair[i] = zlib.crc32(b" " + batch.word(i + 1), int(word[i]))
    return word, pair


def _coded(batches, buckets):
    """For slices of a few megabytes: the slice, its words and the buckets of its words and pairs."""
    for whole in batches:
        for part in slices(whole, whole.column("text")):
            words = Batch(part.column("text"), lower=True, hashed=False, between=_BETWEEN)
            one, two = (codes.astype(np.int64) % buckets for codes in feature_codes(words))
            inside = np.ones(len(one), bool)
            inside[words.first[1:][words.counts > 0] - 1] = False
            yield part, words, one, two, inside


def bucket_counts(texts, buckets=BUCKETS):
    """How many features of all rows fall into each bucket: an array of ``buckets`` integers."""

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for _, _, one, two, inside in _coded(batches, buckets):
            n += np.bincount(one, minlength=buckets) + np.bincount(two[inside], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    every = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for r in every.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(raw, target):
    """Floored thousandfold log ratio of the smoothed shares, bucket by bucket."""
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return [
        math.floor(1000 * math.log((int(t) + 1) * (s_all + b) / ((int(s) + 1) * (t_all + b)))) for s, t in zip(raw, target)
    ]


def scored(docs, gain, seed=7):
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    gain = np.array(gain, np.int64)

    def weigh(batches):
        for part, words, one, two, inside in _coded(batches, len(gain)):
            # gains of a word and of the pair it opens; sums between the bounds of the texts
            total = np.concatenate([[0], np.cumsum(gain[one] + np.where(inside, gain[two], 0))])
            n = np.maximum(2 * words.counts - 1, 0)
            weight = (total[words.first[1:]] - total[words.first[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (words.counts, n, weight))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", (F.col("weight") + noise).cast("long"))


def _best_first(keys):
    """Order of a (4, n) array of keys, best first."""
    return np.lexsort((keys[3], keys[2], keys[1], -keys[0]))


def _compare(keys, pivot):
    """1, 0 or -1 for each key that is better than, equal to or worse than ``pivot``."""
    out = np.zeros(keys.shape[1], np.int8)
    for mine, theirs, sign in ((keys[3], pivot[3], -1), (keys[2], pivot[2], -1), (keys[1], pivot[1], -1), (keys[0], pivot[0], 1)):
        out = np.where(mine == theirs, out, np.where(mine > theirs, sign, -sign))
    return out


def weighted_median(medians, sizes):
    """The median at which half of the rows behind ``medians`` (a list of keys) is reached, best first."""
    keys = np.array(medians, np.int64).T
    order = _best_first(keys)
    at = np.searchsorted(np.cumsum(np.array(sizes)[order]) * 2, sum(sizes))
    return tuple(int(x) for x in keys[:, order[at]])


def _report(best, worst, pivot):
    """A function for ``mapInArrow``: what a partition knows of the open rows on both sides of ``pivot``."""

    def run(batches):
        sides = {1: [], 0: [], -1: []}
        for batch in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)
            if best is not None:
                keys = keys[:, _compare(keys, best) < 0]
            if worst is not None:
                keys = keys[:, _compare(keys, worst) > 0]
            place = _compare(keys, pivot) if pivot is not None else np.ones(keys.shape[1], np.int8)
            for side, found in sides.items():
                here = keys[:, place == side]
                if here.shape[1]:
                    found.append((here.shape[1], here[:, _best_first(here)[here.shape[1] // 2]]))
        rows = []
        for side, found in sides.items():
            if found:
                sizes, medians = zip(*found)
                rows.append((side, sum(sizes), *weighted_median(medians, sizes)))
        names = [f.split()[0] for f in REPORT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)

    return run


def cutoff(keys, k):
    """The ``k``-th best row (from 1) of a table of keys, as (score, no_id, id, row)."""
    best = worst = pivot = None
    size_written = None
    while True:
        told = keys.mapInArrow(_report(best, worst, pivot), REPORT).collect()
        side = {s: [r for r in told if r["place"] == s] for s in (1, 0, -1)}
        above, equal = (sum(r["n"] for r in side[s]) for s in (1, 0))
        if pivot is not None and above < k <= above + equal:
            return pivot
        if pivot is None or k <= above:
            worst, turn = pivot, 1
        else:
            best, k, turn = pivot, k - above - equal, -1
        left = sum(r["n"] for r in side[turn])
        pivot = weighted_median([tuple(r)[2:] for r in side[turn]], [r["n"] for r in side[turn]])
        size_written = size_written or left
        if left * 8 <= size_written:
            keys, size_written = stored(keys.filter(_open(best, worst)), "resample-open"), left


def _better(pivot, equal=False):
    """Whether a row's key is better than ``pivot`` (or equal to it)."""
    s, m, i, r = pivot
    last = F.col("row") <= r if equal else F.col("row") < r
    by_id = (F.col("no_id") < m) | ((F.col("no_id") == m) & ((F.col("id") < i) | ((F.col("id") == i) & last)))
    return (F.col("score") > s) | ((F.col("score") == s) & by_id)


def _open(best, worst):
    wanted = F.lit(True)
    if best is not None:
        wanted = ~_better(best, equal=True)
    return wanted & _better(worst) if worst is not None else wanted


def resample(docs, target, percent=25, least_words=20, buckets=BUCKETS, seed=7):
    """``doc_id, n_words, n_features, weight, score, rank``: the drawn rows are ranked from 1.

    ``percent`` of the rows with ``least_words`` words or more are drawn.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = stored(scored(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    rows = rows.withColumn("no_id", F.col("doc_id").isNull().cast("long")).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    eligible = rows.filter(F.col("n_words") >= least_words)
    k = eligible.count() * percent // 100
    columns = [rows[c] for c in ("doc_id", "n_words", "n_features", "weight", "score")]
    if not k:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & _better(cutoff(eligible.select("score", "no_id", "id", "row"), k), equal=True)
    ranked = number_rows(rows.filter(drawn), [], F.col("score") * -1, ["no_id", "id", "row"], "rank")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = rows.filter(~drawn).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).unionByName(rest)
