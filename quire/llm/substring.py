"""Removal of passages that repeat, within or across documents.

A window is ``window`` consecutive words. Every word that lies in a window whose word
sequence also starts anywhere else is removed; windows are judged on the input.

The documents are cut into slices of a fixed number of rows. Then

1. *Seeds.* Of every window the smallest hash of its ``seed``-word runs is its seed, so
   equal windows have equal seeds and few positions are seeds. Each slice counts its own
   seeds; blocks of seeds of one hash range meet and leave those that occur twice.
2. *Passages.* Slices get back their repeated seeds. Windows below a repeated seed are
   hashed whole and counted in the same way; this confirms which windows recur.
   Documents without a repeated seed are finished here.
3. *Automata.* Each slice gets back its recurring windows. Their maximal stretches are
   its recurring passages; an Aho-Corasick automaton over word numbers is compiled from
   them, one shard per slice, and the slice's documents stream through their shard, which
   finds every occurrence of every passage by the words themselves.

Documents are shuffled once, by slice; those with repeated seeds once more. What travels
besides are 8-byte hashes, one per slice and value, so a passage that stands in a third of
all documents costs one hash per slice, not one per occurrence. A slice holds ``rows``
documents, a hash range a bounded share of all hashes.

Nulls: a null text has no words, like an empty one. Null ids are kept; repeated rows are
documents of their own, so all their windows recur. Texts shorter than a window keep
everything. Extra columns are ignored, an empty table gives no rows.
"""

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quire.llm.common import hash_ranges, stored
from quire.llm.words import Batch, mix

KEYS = "slice long, bucket int, keys binary"
FOUND = "slice long, keys binary"
JUDGED = "slice long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, text string, bucket int, keys binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def sliced(docs, rows=128):
    """``slice, doc_id, text``; the slice follows from file and row, so it is the same at each read."""
    columns = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows)).alias("slice")
    try:
        return docs.select(place, *columns)
    except AnalysisException:  # not a plain table scan: rows have no place yet
        return stored(docs.select(*columns), "passages-input").select(place, *columns)


def _sliding(values, width, best):
    """``best`` over the ``width`` values from each position on (fewer at the end)."""
    out, size = values.copy(), 1
    while size < width:
        step = min(size, width - size)
        if step < len(out):
            out[:-step] = best(out[:-step], out[step:])
        size += step
    return out


def _seeds(b, window, seed):
    """Per word: the seed-run hash, the seed of the window that starts there, whether that window is whole."""
    grams, _ = b.runs(seed)
    whole = np.arange(len(b.start)) + window <= b.first[b.text + 1]
    lowest = _sliding(grams, window - seed + 1, np.minimum)
    return grams, np.where(whole, lowest, np.uint64(0)), whole


def _chosen(grams, lowest, width):
    """Positions whose run is the seed of a window that covers it."""
    back = _sliding(lowest[::-1], width, np.maximum)[::-1]
    return np.flatnonzero((back == grams) & (grams != 0))


def _blocks(slice_id, values, buckets):
    """Rows of ``KEYS``: the distinct values by hash range; a value that occurs again stands twice."""
    values, counts = np.unique(values, return_counts=True)
    values = np.repeat(values, np.minimum(counts, 2))
    bucket = (values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part in np.split(values, cuts):
        if len(part):
            yield slice_id, int((int(part[0]) >> 32) * buckets >> 32), part.tobytes()


def _table(rows, schema):
    return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


_KEYS = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary())])
_FOUND = pa.schema([("slice", pa.int64()), ("keys", pa.binary())])


def recurring(blocks):
    """``FOUND``: per slice the values of its ``KEYS`` blocks that occur twice or more in all."""

    def meet(table):
        owners, keys = table.column("slice").to_pylist(), table.column("keys").to_pylist()
        values = np.frombuffer(b"".join(keys), np.uint64)
        owner = np.repeat(np.arange(len(keys)), [len(k) // 8 for k in keys])
        order = np.argsort(values, kind="stable")
        same = values[order][1:] == values[order][:-1]
        twice = np.zeros(len(values), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        values, owner = values[twice], owner[twice]
        cuts = np.searchsorted(owner, np.arange(len(keys) + 1))
        rows = [(owners[i], np.unique(values[a:b]).tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return _table(rows, _FOUND)

    return blocks.groupBy("bucket").applyInArrow(meet, FOUND)


def _values(table):
    return np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64))


def _member(values, of):
    """Which ``values`` are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _seed_blocks(docs, window, seed, buckets):
    def run(batches):
        for batch in batches:
            slices = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
            rows = []
            for a, z in zip(cuts[:-1], cuts[1:]):
                b = Batch(batch.column(1).slice(a, z - a))
                grams, lowest, _ = _seeds(b, window, seed)
                # seeds are small hashes: scrambled, they spread over all ranges
                rows += _blocks(int(slices[a]), mix(grams[_chosen(grams, lowest, window - seed + 1)]), buckets)
            yield from _table(rows, _KEYS).to_batches()

    return docs.select("slice", "text").mapInArrow(run, KEYS)


def _passages(b, is_recurring):
    """Per text the word ranges ``(from, to)`` of maximal stretches of recurring windows."""
    at = np.flatnonzero(is_recurring)
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(b.text[at]) != 0)) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(at, cut) if len(p)]


def _locate(words, stretches, window):
    """Which words lie in a passage: an automaton of the passages reads all texts.

    ``words`` are the texts as lists of words, ``stretches`` per text the first and last
    window starts of its recurring passages.
    """
    number = {}
    texts = [tuple([number.setdefault(w, len(number)) for w in t]) for t in words]
    shard = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for text, found in zip(texts, stretches):
        for a, z in found:
            shard.add_word(text[a : z + window], z + window - a)
    if not len(shard):  # repeated seeds, but no repeated window
        return [np.zeros(len(text), bool) for text in texts]
    shard.make_automaton()
    covered = []
    for text in texts:
        step = np.zeros(len(text) + 1, np.int64)
        for last, size in shard.iter(text):
            step[last + 1 - size] += 1
            step[last + 1] -= 1
        covered.append(np.cumsum(step[:-1]) > 0)
    return covered


def remove_repeats(docs, window=35, seed=8, rows=128, with_text=True):
    """Rows of ``RESULT``: per document what stays; ``kept`` is null unless ``with_text``."""
    docs = sliced(docs, rows)
    buckets = hash_ranges(docs)
    seeds = recurring(_seed_blocks(docs, window, seed, buckets))
    judged = pa.schema(
        [("slice", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
         ("kept", pa.string()), ("text", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary())]
    )

    def digest(words):
        kept = b" ".join(words)
        return hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None

    def confirm(left, right):
        """Finish documents without a repeated seed; hash the windows below repeated seeds."""
        if not left.num_rows:
            return _table([], judged)
        slice_id = left.column("slice")[0].as_py()
        texts = left.column("text").combine_chunks()
        ids = left.column("doc_id").to_pylist()
        found = _values(right)
        b = Batch(texts)
        _, lowest, whole = _seeds(b, window, seed)
        below = whole & _member(mix(lowest), found)
        hashes, _ = b.runs(window)
        waits = np.bincount(b.text[below], minlength=b.n) > 0
        out = []
        for i, text in enumerate(pc.fill_null(texts, "").to_pylist()):
            if waits[i]:
                out.append((slice_id, ids[i], None, None, None, None, text, None, None))
            else:
                words = text.encode().split()
                out.append((slice_id, ids[i], len(words), 0, *digest(words), None, None, None))
        for s, bucket, keys in _blocks(slice_id, hashes[below], buckets):
            out.append((s, None, None, None, None, None, None, bucket, keys))
        return _table(out, judged)

    first = docs.groupBy("slice").cogroup(seeds.groupBy("slice")).applyInArrow(confirm, JUDGED)
    first = stored(first, "passages-confirmed")
    windows = recurring(first.filter(F.col("keys").isNotNull()).select("slice", "bucket", "keys"))
    waiting = first.filter(F.col("text").isNotNull()).select("slice", "doc_id", "text")
    result = pa.schema([judged.field(c) for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")])

    def remove(left, right):
        if not left.num_rows:
            return _table([], result)
        texts = left.column("text").combine_chunks()
        b = Batch(texts)
        hashes, whole = b.runs(window)
        stretches = [[] for _ in range(b.n)]
        for a, z in _passages(b, whole & _member(hashes, _values(right))):
            i = int(b.text[a])
            stretches[i].append((a - int(b.first[i]), z - int(b.first[i])))
        words = [t.encode().split() for t in texts.to_pylist()]
        out = []
        for doc, text, covered in zip(left.column("doc_id").to_pylist(), words, _locate(words, stretches, window)):
            kept = [w for w, c in zip(text, covered.tolist()) if not c]
            out.append((doc, len(text), len(text) - len(kept), *digest(kept)))
        return _table(out, result)

    rest = waiting.groupBy("slice").cogroup(windows.groupBy("slice")).applyInArrow(remove, RESULT)
    done = first.filter(F.col("n_words").isNotNull()).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
    return done.unionByName(rest)
