"""Byte-level BPE by corpus-level merge replay, and its inverse.

Spark cuts the corpus into slices of whole documents. In a slice the distinct pieces
(matches of the splitting pattern) are laid out as one long array of byte tokens, and an
inverted index maps each pair, by the rank of its union, to the positions where it
stands. ``replay`` walks the index in rank order: it merges all positions of the lowest
rank and touches only the neighbours of what it merged. So a merge is looked up once per
slice, not once per word and document.

Order inside a piece is that of the usual encoder: lowest rank first, leftmost first. A
merge may create a pair of a *lower* rank than its own; ranks for which that can happen
are replayed one position per piece at a time, so the lower rank gets its turn.

Nulls: a null text is empty (no tokens, digest of no bytes). Null ids are kept, repeated
rows are encoded each, an empty table gives no rows, other columns are ignored. Texts are
never cut; a slice is one text at least.
"""

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm.common import worker_cache
from quire.llm.packing import groups_of

ENCODED = "doc_id long, n_tokens long, ids binary"
#: The characters with the White_Space property, as a character class (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of other characters with the space before it, or white space as the pattern splits it.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def read_ranks(path):
    """Token bytes -> rank of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """The rank file as arrays: sorted pair keys, the token each pair makes, unsafe ranks."""

    def __init__(self, ranks):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.makes = np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.unsafe = np.zeros(self.size, bool)
        for part in (self.keys // self.size, self.keys % self.size):
            self.unsafe[part[self.makes < part]] = True
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def of(self, left, right):
        """Rank of each pair's union; ``size`` where the pair does not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.makes[at], self.size)


def replay(merges, pieces):
    """Token ids of each of the distinct byte strings ``pieces``, as little-endian bytes."""
    none = merges.size
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    n = len(data)
    token = merges.byte[data]
    piece = np.repeat(np.arange(len(pieces)), lengths)
    after = np.arange(1, n + 1)
    after[ends - 1] = -1
    before = np.arange(-1, n - 1)
    before[ends - lengths] = -1
    pair = np.full(n, none, np.int64)
    inner = np.flatnonzero(after >= 0)
    pair[inner] = merges.of(token[inner], token[inner + 1])
    alive = np.ones(n, bool)

    index, queue = {}, []

    def add(positions):
        """Put positions into the index under the rank of the pair that starts there."""
        ranks = pair[positions]
        keep = ranks < none
        positions, ranks = positions[keep], ranks[keep]
        if not len(positions):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts)):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(queue, rank)

    add(inner)
    while queue:
        rank = heapq.heappop(queue)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[pair[at] == rank]
        if merges.unsafe[rank] and len(at) > 1:
            first = np.ones(len(at), bool)
            first[1:] = piece[at[1:]] != piece[at[:-1]]
            if not first.all():
                index[rank] = [at[~first]]
                heapq.heappush(queue, rank)
                at = at[first]
        elif len(at) > 1:
            # of positions that overlap in a chain, the first, third, ... merge
            linked = np.zeros(len(at), bool)
            linked[1:] = after[at[:-1]] == at[1:]
            if linked.any():
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(linked, 0, place))
                at = at[(place - start) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        token[at] = rank
        alive[gone] = False
        pair[gone] = none
        right = after[gone]
        after[at] = right
        has = right >= 0
        before[right[has]] = at[has]
        pair[at] = none
        pair[at[has]] = merges.of(token[at[has]], token[right[has]])
        left = before[at]
        left = left[left >= 0]
        pair[left] = merges.of(token[left], token[after[left]])
        add(np.unique(np.concatenate((at[has], left))))
    kept = np.flatnonzero(alive)
    raw = token[kept].astype("<u4").tobytes()
    cut = 4 * np.searchsorted(kept, ends)
    return [raw[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]


class Encoder:
    """Ids of texts by merge replay over what a slice holds that was not seen before.

    ``room`` bounds how many chunks are remembered from slice to slice; a full memory
    starts anew, which costs time but changes no id.
    """

    def __init__(self, path, pattern, room=600_000):
        import regex

        self.merges = Merges(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.room, self.chunks, self.pieces = room, {}, {}

    def _learn(self, chunks):
        cut = {c: self.split(c) for c in chunks}
        fresh = list({p for parts in cut.values() for p in parts if p not in self.pieces})
        known, rest = [], []
        for p in fresh:
            (known if p.encode() in self.merges.ranks else rest).append(p)
        for p in known:
            self.pieces[p] = np.array([self.merges.ranks[p.encode()]], "<u4").tobytes()
        if rest:
            self.pieces.update(zip(rest, replay(self.merges, [p.encode() for p in rest])))
        for chunk, parts in cut.items():
            self.chunks[chunk] = b"".join([self.pieces[p] for p in parts])

    def encode(self, texts):
        """Little-endian unsigned 32-bit ids of each text, as bytes."""
        cut = [CHUNK.findall(t) for t in texts]
        every = set().union(*cut)
        new = every.difference(self.chunks)
        if new:
            if len(self.chunks) + len(new) > self.room:
                self.chunks.clear()
                self.pieces.clear()
                new = every
            self._learn(new)
        get = self.chunks.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]

    def decode(self, ids):
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.merges.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(path, pattern):
    cache = worker_cache("bpe_encoder")
    if (path, pattern) not in cache:
        cache[path, pattern] = Encoder(path, pattern)
    return cache[path, pattern]


def _in_slices(batch, limit=1 << 24):
    """Ids and texts of a batch in slices of at most ``limit`` characters, one text at least."""
    ids = batch.column(0).to_pylist()
    texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
    for a, b in groups_of([len(t) for t in texts], limit):
        yield ids[a:b], texts[a:b]


def encode(docs, ranks_path, pattern, id_col="doc_id", text_col="text"):
    """Rows of ``ENCODED``: ids of every text as little-endian unsigned 32-bit integers."""

    def run(batches):
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            for ids, texts in _in_slices(batch):
                coded = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ENCODED)


def decode(encoded, ranks_path, pattern):
    """Rows of ``ENCODED`` with ``decoded``, the bytes that the ids stand for."""

    def run(batches):
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            raw = [None if c is None else encoder.decode(c) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, ENCODED + ", decoded binary")


def round_trip_digests(docs, ranks_path, pattern):
    """Encode, decode, and keep digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches):
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            for ids, texts in _in_slices(batch):
                rows = [
                    (doc, len(c) // 4, hashlib.sha256(c).hexdigest(), hashlib.sha256(encoder.decode(c)).hexdigest())
                    for doc, c in zip(ids, encoder.encode(texts))
                ]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
