"""Best-fit packing of tokenised documents into sequences of a fixed length.

``token_pieces`` tokenises and cuts; ``pack`` places pieces by best fit in order of size.
Pieces of one size are interchangeable, so the plan needs their numbers only:

1. Spark counts the pieces of each size, at most ``capacity`` numbers.
2. ``best_fit`` goes through the sizes from the largest down. A piece goes into the smallest
   gap that it fits, or opens a sequence; sequences with equal gaps are treated together,
   as runs of sequence numbers. The plan has one row per size and run, so its length
   follows from the sizes and the capacity, not from the number of pieces.
3. Spark ranks the pieces of each size, bucket by bucket, so that a size of a third of all
   rows is spread out, and looks up each rank in the plan.

Nulls: a null text is empty, hence only the end id. A null ``doc_id`` is kept. Repeated
rows are packed one by one. An empty table gives no pieces. Other columns are ignored.
"""

import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions.scale import number_rows
from quire.llm.common import stored, worker_cache
from quire.llm.words import Batch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Letters, then signs: the tokenizer splits between them and encodes each part by itself.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: UTF-8 lead bytes of the marks that an ASCII letter can be composed with.
MARKS = b"\xcc", b"\xcd"
#: A full stop or comma that may be part of a longer run of signs.
JOINED = re.compile(rb"[^0-9A-Za-z\s][.,][ \n]")


class WordEncoder:
    """Token ids of texts, one dictionary look-up per distinct word of some texts.

    The tokenizer splits at white space and never looks across it, so ids of a text are
    the ids of its words in order. It folds case after composing marks with letters, so
    ASCII letters can be folded first in a text without such marks; and it parts signs from
    letters, so a full stop or comma after a letter can be a word of its own. New words are
    encoded by the tokenizer in bulk; plain words skip its normaliser. ``room`` bounds the
    dictionary: when it is full it starts anew, which costs time but changes no id.
    """

    def __init__(self, path, room=1_000_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.full.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.room, self.words = room, {b"": b""}

    def _add(self, words):
        """Encode words one by one; without offsets, which nothing here reads."""
        coded = self.full.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.words.update((w, array("I", c.ids).tobytes()) for w, c in zip(words, coded))

    def _learn(self, words):
        known, shape, fresh, other = self.words, [], set(), set()
        for word in words:
            core = word.rstrip(SIGNS)
            if not (core.isalpha() and core.islower()):
                m = PLAIN.fullmatch(word.decode())
                core = m and m[1].lower().encode()
            if not core:
                other.add(word)
                continue
            if core not in known:
                fresh.add(core)
            if core != word:
                signs = word[len(core) :]
                shape.append((word, core, signs))
                if signs not in known:
                    other.add(signs)
        fresh, other = list(fresh), list(other)
        # the tokenizer's time per word grows with the length of the line
        for i in range(0, len(fresh), 256):
            part = fresh[i : i + 256]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                self._add(part)
                continue
            raw, a = ids.tobytes(), 0
            for word, b in zip(part, (4 * ends).tolist()):
                known[word] = raw[a:b]
                a = b
        for i in range(0, len(other), 4096):
            self._add(other[i : i + 4096])
        for word, core, signs in shape:
            known[word] = known[core] + known[signs]

    def encode(self, texts):
        """Little-endian unsigned 32-bit ids of each text, as bytes."""
        folded = []
        for text in texts:
            raw = text.encode()
            if MARKS[0] not in raw and MARKS[1] not in raw:
                raw = raw.lower()
            if not JOINED.search(raw):
                raw = raw.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n")
            folded.append(raw)
        batch = Batch(pa.array(folded, pa.large_binary()).view(pa.large_string()), hashed=False)
        # each word with the white space behind it
        bounds = pa.py_buffer(np.append(batch.start, len(batch.buf)))
        found = pa.Array.from_buffers(pa.large_binary(), len(batch.start), [None, bounds, pa.py_buffer(batch.buf)]).dictionary_encode()
        _, bounds, data = found.dictionary.buffers()
        data, bounds = data.to_pybytes() if data else b"", np.frombuffer(bounds, np.int64)[: len(found.dictionary) + 1].tolist()
        words = [data[a:b].rstrip() for a, b in zip(bounds[:-1], bounds[1:])]
        new = {w for w in words if w not in self.words}
        if len(self.words) + len(new) > self.room:
            new, self.words = set(words), {b"": b""}
        self._learn(new)
        coded = [self.words[w] for w in words]
        ids, size = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        # tokens of every word in order, and where each text begins
        word = found.indices.to_numpy()
        ends = np.cumsum(size[word])
        before = (np.cumsum(size) - size)[word] - (ends - size[word])
        out = ids[np.repeat(before, size[word]) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[batch.first].tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def token_pieces(docs, tokenizer_path, limit=2048, end_id=0, id_col="doc_id", text_col="text"):
    """Rows of ``PIECES``: each document's ids plus ``end_id``, cut where longer than ``limit``."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = worker_cache("word_encoder")
        if tokenizer_path not in cache:
            cache[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder = cache[tokenizer_path]
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for a, b in groups_of([len(t) for t in texts], 1 << 22):
                rows = []
                for doc, raw in zip(ids[a:b], encoder.encode(texts[a:b])):
                    raw += end
                    total = len(raw) // 4
                    for piece, start in enumerate(range(0, total, limit)):
                        part = raw[4 * start : 4 * (start + limit)]
                        rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def groups_of(sizes, limit):
    """Bounds of consecutive runs whose sizes add up to ``limit`` at most, or of one item."""
    a, total = 0, 0
    for i, size in enumerate(sizes):
        if i > a and total + size > limit:
            yield a, i
            a, total = i, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def best_fit(counts, capacity):
    """Best fit in order of size for ``counts`` of pieces per size: rows of a plan.

    A row ``(size, first, times, sequence, place)`` puts the pieces of a size, numbered
    from ``first`` on, ``times`` each into the sequences from ``sequence`` on, at ``place``.
    """
    rooms, gaps = [], {}  # free room in order; free room -> runs (first sequence, how many)
    rows, opened = [], 0

    def add(room, sequence, number):
        if room and number:
            if room not in gaps:
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((sequence, number))

    for size in sorted(counts, reverse=True):
        first, end = 0, counts[size]
        while first < end:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                sequence, number = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], rooms[at]
            else:
                room, sequence, number = capacity, opened, -(-(end - first) // (capacity // size))
                opened += number
            # what is left of a gap is the next smallest that fits: one gap is filled after the other
            times = room // size
            full = min(number, (end - first) // times)
            for many, each in ((full, times), (min(1, number - full), end - first - full * times)):
                if many and 0 < each <= times:
                    rows.append((size, first, each, sequence, capacity - room))
                    add(room - each * size, sequence, many)
                    first, sequence, number = first + many * each, sequence + many, number - many
            add(room, sequence, number)
    return rows


def pack(pieces, capacity=2048):
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``.

    The input is read three times and must give the same rows each time: pass a stored
    table with a unique ``uid``. Sequences are filled without gaps from offset 0.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(sorted(best_fit(counts, capacity)), np.int64).reshape(-1, 5)
    ranks = 1 << 40
    keys, (first, times, sequence, place) = plan[:, 0] * ranks + plan[:, 1], plan[:, 1:].T.copy()
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    at_length, at_rank = pieces.columns.index("length"), len(pieces.columns)

    def run(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy().astype(np.int64) for c in (at_length, at_rank))
            at = np.searchsorted(keys, size * ranks + rank, side="right") - 1
            group, inside = np.divmod(rank - first[at], times[at])
            columns = [pa.array(sequence[at] + group), pa.array(place[at] + inside * size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_rank], *columns], schema.names)

    ranked = number_rows(pieces, ["length"], F.pmod(F.xxhash64("uid"), F.lit(64)), ["uid"], "rank")
    return ranked.select(*pieces.columns, (F.col("rank") - 1).cast("long")).mapInArrow(run, schema)


def pack_documents(docs, tokenizer_path, capacity=2048, end_id=0):
    """Tokenise, cut and pack ``docs``: ``PIECES`` plus ``sequence_id`` and ``offset``."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id)
    pieces = stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
