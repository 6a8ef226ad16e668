"""Self-join of documents on the Jaccard similarity of their word n-grams, size-aware.

A document's set holds the distinct hashes of its ``n`` -word runs (the whole text, if it
is shorter). Documents with equal sets are one *class* from the start. Two sets link when
``100 * shared >= percent * union``, so they share at least ``percent`` per cent of the
larger set.

1. *Recurrence.* Every set sends the smallest part of its hashes (long enough that linked
   sets share a known number in it, by the prefix principle). A set that does not find
   that number elsewhere links with nothing and is finished.
2. *Frequencies.* What is left counts how many sets hold each hash; sets with too few
   shared hashes drop out again.
3. *Light sets* enumerate their subsets of every size that a link may need; two light sets
   that link share such a subset. *Heavy sets* scan inverted lists: of a set's hashes in
   order of rarity, as many as it could lose plus one go into lists, and linked sets meet
   in one. The boundary size is the one with the smallest cost, subsets written against
   list entries met.
4. *Check.* A list first compares its members with one hub, exactly, on whole sets; some
   turns with other hubs follow, for members that are not in the hub's component yet. Then
   every list whose members still lie in different components compares all of them across
   components, each pair once, in the list of its first shared key; a bit map of each set
   rules out pairs that differ in too many hashes (a bound, so it rules out no link). So a list of thousands of near copies costs a few comparisons per member,
   and no link between components is lost.

Sets travel as packed hashes by slices of rows, never one row per n-gram; hot values are
counted per slice before the shuffle.

Nulls: a null text has no words, like an empty one: an empty set, linked with nothing. A
null ``doc_id`` names its component last. Repeated rows are equal sets. Extra columns are
ignored; an empty table gives no rows.
"""

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quire.llm.common import hash_ranges, stored
from quire.llm.words import Batch, mix

LAST = 2**63 - 1
LIGHT_MOST = 12
EXTRA = 0.15


def placed(docs, rows, *columns):
    """``slice, row, doc_id, text`` (or ``columns``): the place of each row, the same at each read."""
    columns = columns or (F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = (
        F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows)).alias("slice"),
        (F.col("_metadata.row_index") % rows).cast("int").alias("row"),
    )
    try:
        return docs.select(*place, *columns)
    except AnalysisException:  # not a plain table scan: rows have no place yet
        return stored(docs.select(*columns), "join-input").select(*place, *columns)


def shingle_sets(texts, n):
    """The sorted distinct n-gram hashes of each text of an Arrow array."""
    b = Batch(texts, lower=True)
    runs, whole = b.runs(n)
    order = np.flatnonzero(whole)
    by_text = np.searchsorted(b.text[order], np.arange(b.n + 1))
    values = runs[order]
    out = []
    for i in range(b.n):
        part = values[by_text[i] : by_text[i + 1]]
        if not len(part) and b.counts[i]:
            # fewer than n words: the whole sequence, told apart by its length
            words = b.hash[b.first[i] : b.first[i + 1]]
            part = np.array([len(words)], np.uint64)
            for w in words:
                part = mix(part * np.uint64(31) + w)
        out.append(np.unique(part))
    return out


def least_shared(size, percent):
    """Fewest hashes that a set of ``size`` shares with any set it links with."""
    return -(-percent * size // 100)


def _prefix(size, percent):
    """Length of the recurrence prefix of a set, and how many of it must be found elsewhere."""
    return size - least_shared(size, percent) + max(1, int(EXTRA * size)), max(1, int(EXTRA * least_shared(size, percent)))


_FIRST = pa.schema(
    [("slice", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("need", pa.int64()),
     ("print", pa.binary()), ("bucket", pa.int32()), ("keys", pa.binary()), ("rows", pa.binary())]
)
_FIRST_DDL = "slice long, row int, doc_id long, n_shingles long, need long, print binary, bucket int, keys binary, rows binary"


def _rows(rows, schema):
    return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def _runs_of(values):
    return zip(*(lambda c: (c[:-1], c[1:]))([0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]))


def _first_pass(docs, n, percent, buckets):
    """Per document size and fingerprint of its set; per slice and bucket the prefix hashes."""

    def run(batches):
        for batch in batches:
            slices, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids = batch.column(2).to_pylist()
            for a, z in _runs_of(slices):
                out, values, owners = [], [], []
                for i, found in enumerate(shingle_sets(batch.column(3).slice(a, z - a), n)):
                    length, need = _prefix(len(found), percent)
                    out.append((int(slices[a]), int(places[a + i]), ids[a + i], len(found), need,
                                hashlib.md5(found.tobytes()).digest() if len(found) else None, None, None, None))
                    values.append(found[:length])
                    owners.append(np.full(len(values[-1]), places[a + i], np.uint8))
                values, owners = np.concatenate(values), np.concatenate(owners)
                # a scrambled copy deals the hashes out: prefixes hold small ones only
                dealt = mix(values)
                order = np.argsort(dealt)
                dealt, owners = dealt[order], owners[order]
                bucket = (dealt >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                for s, e in _runs_of(bucket):
                    if e > s:
                        out.append((int(slices[a]), None, None, None, None, None, int(bucket[s]), dealt[s:e].astype("<u4").tobytes(), owners[s:e].tobytes()))
                yield from _rows(out, _FIRST).to_batches()

    return docs.mapInArrow(run, _FIRST_DDL)


def _found_elsewhere(blocks, width):
    """Per slice and row how many prefix hashes another row has too."""
    schema = pa.schema([("slice", pa.int64()), ("counts", pa.binary())])

    def meet(table):
        slices, keys, rows = (table.column(c).to_pylist() for c in ("slice", "keys", "rows"))
        values = np.frombuffer(b"".join(keys), "<u4")
        row = np.frombuffer(b"".join(rows), np.uint8).astype(np.int64)
        block = np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys])
        order = np.argsort(values, kind="stable")
        same = values[order][1:] == values[order][:-1]
        again = np.zeros(len(values), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        counts = np.bincount((block * width + row)[again], minlength=len(keys) * width).astype("<u4").reshape(len(keys), width)
        return _rows([(slices[i], counts[i].tobytes()) for i in np.flatnonzero(counts.any(axis=1)).tolist()], schema)

    def add(table):
        total = sum(np.frombuffer(c, "<u4").astype(np.int64) for c in table.column("counts").to_pylist())
        slice_id = table.column("slice")[0].as_py()
        return pa.table({"slice": [slice_id] * width, "row": pa.array(range(width), pa.int32()), "found": pa.array(total, pa.int64())})

    met = blocks.groupBy("bucket").applyInArrow(meet, "slice long, counts binary")
    return met.groupBy("slice").applyInArrow(add, "slice long, row int, found long").filter("found > 0")


def _frequencies(sets, buckets):
    """Per slice the hashes of its sets with the number of sets that hold them, if over one."""
    blocks = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def cut(table):
        slice_id = table.column("slice")[0].as_py()
        values, counts = np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64), return_counts=True)
        bucket = (values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return _rows([(slice_id, int(bucket[s]), values[s:e].tobytes(), counts[s:e].astype("<u2").tobytes()) for s, e in _runs_of(bucket) if e > s], blocks)

    def count(table):
        slices, keys, counts = (table.column(c).to_pylist() for c in ("slice", "keys", "counts"))
        values = np.frombuffer(b"".join(keys), np.uint64)
        kinds, back = np.unique(values, return_inverse=True)
        total = np.bincount(back, np.frombuffer(b"".join(counts), "<u2"), len(kinds)).astype(np.int64)[back]
        edges = np.cumsum([0, *(len(k) // 8 for k in keys)])
        out = []
        for i, slice_id in enumerate(slices):
            v, t = values[edges[i] : edges[i + 1]], total[edges[i] : edges[i + 1]]
            if (t > 1).any():
                out.append((slice_id, v[t > 1].tobytes(), t[t > 1].astype("<i8").tobytes()))
        return _rows(out, pa.schema([("slice", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    cut_up = sets.groupBy("slice").applyInArrow(cut, "slice long, bucket int, keys binary, counts binary")
    return cut_up.groupBy("bucket").applyInArrow(count, "slice long, keys binary, counts binary")


def _subset_keys(values, percent):
    """Hashes of all subsets of a size that a link with an equal or smaller set may need."""
    out = []
    for c in range(least_shared(len(values), percent), len(values) + 1):
        for chosen in combinations(values.tolist(), c):
            out.append(int.from_bytes(hashlib.blake2b(np.array(chosen, np.uint64).tobytes(), digest_size=8).digest(), "little", signed=True))
    return out


_LISTED = "slice long, row int, size long, cost long, list_keys array<long>, places array<int>, subset_keys array<long>, bits array<long>"
#: Bits of the map of a set, a power of two.
MAP = 1024


def _listed(sets, frequencies, percent):
    """Sets with enough shared hashes, with their list keys (rarest first) and subset keys.

    ``places`` are the places of the list keys among all hashes of the set, in that order.
    """
    schema = pa.schema([("slice", pa.int64()), ("row", pa.int32()), ("size", pa.int64()), ("cost", pa.int64()),
                        ("list_keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("subset_keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(left, right):
        known = np.frombuffer(b"".join(right.column("keys").to_pylist()), np.uint64)
        total = np.frombuffer(b"".join(right.column("counts").to_pylist()), "<i8")
        order = np.argsort(known)
        known, total = known[order], total[order]
        out = []
        for slice_id, row, raw in zip(*(left.column(c).to_pylist() for c in ("slice", "row", "keys"))):
            values = np.frombuffer(raw, np.uint64)
            count = np.ones(len(values), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                count = np.where(known[at] == values, total[at], 1)
            least = least_shared(len(values), percent)
            if (count > 1).sum() < least:
                continue
            rare = np.lexsort((values, count))[: len(values) - least + 1]
            places = np.flatnonzero(count[rare] > 1)
            rare = rare[places]
            keys = values[rare].view(np.int64).tolist()
            subsets = _subset_keys(values, percent) if len(values) <= LIGHT_MOST else None
            bits = np.zeros(MAP, np.uint8)
            bits[values >> np.uint64(64 - MAP.bit_length() + 1)] = 1
            bits = np.packbits(bits).view(np.int64).tolist()
            out.append((slice_id, row, len(values), int(count[rare].sum()), keys, places.tolist(), subsets, bits))
        return _rows(out, schema)

    return sets.groupBy("slice").cogroup(frequencies.groupBy("slice")).applyInArrow(run, _LISTED)


def _boundary(listed, percent):
    """The largest size of a light set with the smallest total cost (at most ``LIGHT_MOST``)."""
    rows = listed.filter(F.col("size") <= LIGHT_MOST).groupBy("size").agg(F.count("*").alias("n"), F.sum("cost").alias("cost")).collect()
    subsets = lambda s: sum(comb(s, c) for c in range(least_shared(s, percent), s + 1))
    gain = {r["size"]: r["cost"] - r["n"] * subsets(r["size"]) for r in rows}
    best, total, at = 0, 0, 0
    for size in range(1, LIGHT_MOST + 1):
        total += gain.get(size, 0)
        if total > best:
            best, at = total, size
    return at


def _verified(pairs, sets, percent):
    """Those of the pairs ``(a, b)`` of set numbers that link, compared on whole sets."""
    # at most two sets travel per pair
    both = (
        pairs.join(sets.select(F.col("set_id").alias("a"), F.col("keys").alias("left")), "a")
        .join(sets.select(F.col("set_id").alias("b"), F.col("keys").alias("right")), "b")
    )

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


#: Edges that one task joins to trees by itself.
EDGES = 1_000_000


def _trees(a, b):
    """The nodes of some edges, and the smallest node that each is linked with."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def components(edges, name="components", share=EDGES):
    """``node, label``: the smallest node of each component, for nodes that have an edge.

    A task joins a ``share`` of the edges to trees by itself. Where there are more, rounds
    settle what is left: every round takes the smallest label around and then the label's
    own label, and is written to the shared folder.
    """
    edges = stored(edges.select("a", "b"), name)
    tasks = max(1, -(-edges.count() // share))

    def run(batches):
        batches = [pa.RecordBatch.from_arrays(x.columns, ["a", "b"]) for x in batches]
        if batches:
            table = pa.Table.from_batches(batches)
            nodes, labels = _trees(table.column("a").to_numpy(), table.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "label"])

    trees = edges.coalesce(tasks).mapInArrow(run, "node long, label long")
    if tasks == 1:
        return trees
    trees = trees.filter("node != label")
    both = stored(trees.select("node", F.col("label").alias("other")).unionByName(trees.select(F.col("label").alias("node"), F.col("node").alias("other"))), name)
    labels = stored(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label")), name)
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        after = stored(moved.join(jump, "to", "left").select("node", "old", F.coalesce("far", "to").alias("label")), name)
        labels = after.select("node", "label")
        if after.filter("old != label").isEmpty():
            return labels


def _mixed(told):
    """Entries of lists whose members lie in different components."""
    lists = told.groupBy("subset", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
    return told.join(lists.select("subset", "key"), ["subset", "key"], "left_semi")


def _relabelled(told, links):
    """Entries with the labels that ``links`` between their sets lead to."""
    of = told.select("set_id", "label").distinct()
    edges = links.join(of.select(F.col("set_id").alias("a"), F.col("label").alias("x")), "a").join(
        of.select(F.col("set_id").alias("b"), F.col("label").alias("y")), "b"
    )
    moved = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    moved = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return told.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def link_documents(docs, n=5, percent=75, rows=128, hub_turns=3):
    """``slice, row, doc_id, n_shingles, component_id, n_equal, stays`` of every row.

    ``n_equal`` counts the rows with an equal set; ``stays`` marks one row of a component.
    """
    docs = placed(docs, rows)
    buckets = hash_ranges(docs)
    first = stored(_first_pass(docs, n, percent, buckets), "join-first")
    members = first.filter(F.col("n_shingles").isNotNull()).select("slice", "row", "doc_id", "n_shingles", "need", "print")
    found = _found_elsewhere(first.filter(F.col("keys").isNotNull()).select("slice", "bucket", "keys", "rows"), rows)
    # one row stands for all rows with an equal set
    classes = members.filter(F.col("print").isNotNull()).groupBy("print").agg(
        F.min(F.struct("slice", "row")).alias("at"), F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "slice", "row")).alias("best"), F.count("*").alias("n_equal")
    )
    classes = stored(classes.select(F.monotonically_increasing_id().alias("set_id"), "print", "at.slice", "at.row", "best", "n_equal"), "join-classes")
    alive = members.select("slice", "row", "need").join(found, ["slice", "row"]).filter(F.col("found") >= F.col("need"))
    alive = classes.select("set_id", "slice", "row").join(alive.select("slice", "row"), ["slice", "row"])

    def whole_sets(batches):
        for batch in batches:
            keys = [s.tobytes() for s in shingle_sets(batch.column(3), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary())], ["slice", "row", "set_id", "keys"])

    texts = docs.select("slice", "row", "text").join(alive, ["slice", "row"]).select("slice", "row", "set_id", "text")
    sets = stored(texts.mapInArrow(whole_sets, "slice long, row int, set_id long, keys binary"), "join-sets")
    listed = _listed(sets.select("slice", "row", "keys"), _frequencies(sets.select("slice", "keys"), buckets), percent)
    listed = stored(listed.join(sets.select("slice", "row", "set_id"), ["slice", "row"]).drop("slice", "row"), "join-lists")
    light = F.col("size") <= _boundary(listed, percent)
    entries = listed.select("set_id", "size", light.alias("light"), F.lit(False).alias("subset"), "places", F.posexplode("list_keys").alias("pos", "key")).withColumn("place", F.element_at("places", F.col("pos") + 1)).drop("places").unionByName(
        listed.filter(light).select("set_id", "size", light.alias("light"), F.lit(True).alias("subset"), F.lit(0).alias("pos"), F.explode("subset_keys").alias("key"), F.lit(0).alias("place"))
    )
    entries = stored(entries, "join-entries")
    links = None
    told = entries.withColumn("label", F.col("set_id"))
    for turn in range(hub_turns):
        mixed = _mixed(told)
        # first one hub for all lists of a group, then another one for each list
        order = F.xxhash64("set_id", F.lit(turn), "key") if turn else F.col("set_id")
        hubs = mixed.groupBy("subset", "key").agg(F.min(F.struct(order, F.struct("set_id", "label"))).alias("hub"))
        hubs = hubs.select("subset", "key", F.col("hub.col2.set_id").alias("b"), F.col("hub.col2.label").alias("label_b"))
        pairs = mixed.join(hubs, ["subset", "key"]).filter("label != label_b").select(F.col("set_id").alias("a"), "b").distinct()
        new = stored(_verified(pairs, sets, percent), "join-links")
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        told = stored(_relabelled(mixed, new), "join-told")
    told = stored(_mixed(told), "join-told")
    earlier = F.when(F.col("subset"), F.array().cast("array<long>")).otherwise(F.slice("list_keys", 1, F.col("pos"))).alias("earlier")
    told = told.join(listed.select("set_id", "bits", "list_keys"), "set_id").select("subset", "key", "set_id", "size", "light", "label", "place", "bits", earlier)
    columns = ("size", "light", "label", "place", "bits", "earlier")
    side = lambda x: told.select("subset", "key", F.col("set_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    left, right = side("a"), side("b")
    # every differing bit stands for a hash that only one of the sets holds
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most_apart = (100 - percent) * (F.col("size_a") + F.col("size_b")) / (100 + percent)
    # from the first shared hash on, either set holds as many as a link needs
    room = " AND ".join(f"(size_{x} - place_{x}) * {100 + percent} >= {percent} * (size_a + size_b)" for x in "ab")
    across = (
        left.join(right, ["subset", "key"])
        .filter("label_a < label_b")
        .filter(f"100 * size_a >= {percent} * size_b AND 100 * size_b >= {percent} * size_a")
        # light sets that link meet by a subset
        .filter("subset OR NOT (light_a AND light_b)")
        .filter(f"subset OR ({room})")
        .filter(apart <= most_apart)
        # of the lists that hold both sets, that of the first key compares them
        .filter("NOT arrays_overlap(earlier_a, earlier_b)")
        .select("a", "b")
        .distinct()
    )
    rest = stored(_verified(across, sets, percent), "join-links")
    labels = components(rest if links is None else links.unionByName(rest))
    named = classes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    names = named.groupBy("label").agg(F.min("best").alias("best_of_all"))
    named = named.join(names, "label").select("print", "n_equal", "best_of_all")
    best = F.col("best_of_all")
    stays = (best["slice"] == F.col("slice")) & (best["row"] == F.col("row"))
    name = F.when(best["rank"] != LAST, best["rank"]).alias("component_id")
    linked = members.filter(F.col("print").isNotNull()).join(named, "print")
    linked = linked.select("slice", "row", "doc_id", "n_shingles", name, "n_equal", stays.alias("stays"))
    empty = members.filter(F.col("print").isNull()).select(
        "slice", "row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_equal"), F.lit(True).alias("stays")
    )
    return linked.unionByName(empty)


def distinct_documents(docs, n=5, percent=75, rows=128):
    """``docs`` with one row of each component (smallest ``doc_id``); same columns."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not a plain table scan: rows have no place yet
        docs = stored(docs, "join-documents")
    gone = link_documents(docs, n, percent, rows).filter("NOT stays").select(F.col("slice").alias("_slice"), F.col("row").alias("_row"))
    every = placed(docs, rows, *docs.columns).toDF("_slice", "_row", *docs.columns)
    return every.join(gone, ["_slice", "_row"], "left_anti").select(*docs.columns)
