"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two words counts common letter triples that appear in order, at most
``SPAN`` characters apart in all; a triple weighs ``DECAY`` for each character it skips.
Words are folded first (case, accents, look-alike digits), symbols inside a word are
skipped and letters set apart by blanks are one word, so gapped and padded insults stay
close to the plain ones. Normalised kernel values below ``FLOOR`` count as zero.

*Landmarks* are words that toxic training texts use in many surroundings and clean ones
do not. A sentence is described by its best kernel value with each landmark, carried into
the Nystroem space of the landmarks; a squared-hinge support vector machine separates
sentences. A clean document vouches for all its sentences, a toxic one for its worst and
for those the last fit found toxic, so the fit is repeated a few times. The score of a document is the
calibrated decision on its worst sentence.

Training reads a bounded sample: at most ``per_class`` labelled documents of each class
(smallest hash of the id), whole texts. Scoring covers every document: most words are
ruled out by an upper bound of the kernel in a few array operations; it never rules out a
word that the kernel would not set to zero.

Nulls: a null text is empty; empty texts get the score of a text without any suspicious
word. Labels other than 0 and 1 and labels of unknown documents are ignored; a document
labelled twice is trained twice. Without both classes in the sample the score is 0.
Null ids, repeated rows and extra columns pass as in a projection.
"""

import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm.packing import groups_of
from quire.llm.words import mix

SPAN, DECAY, FLOOR = 6, 0.7, 0.5
THRESHOLD = 0.7
#: The machine uses this power of the kernel, which is a kernel too.
POWER = 3
_CLASSES = 40
_SKIP, _BLANK, _OTHER = 255, 0, 37
#: Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _char_class(code):
    c = chr(code)
    if c in " \t\n\r\x0b\x0c":
        return _BLANK
    c = LOOKALIKES.get(c, unicodedata.normalize("NFKD", c.lower())[:1].lower())
    if "a" <= c <= "z":
        return ord(c) - 96
    if "0" <= c <= "9":
        return ord(c) - 48 + 27
    return _OTHER if c.isalpha() else _SKIP


_CHARS = np.array([_char_class(c) for c in range(0x250)], np.uint8)


class Text:
    """Folded characters of some texts: class, word and sentence of each, text of each word."""

    def __init__(self, texts):
        raw = "\n".join(texts) + "\n"
        code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        kind = np.where(code < 0x250, _CHARS[np.minimum(code, 0x24F)], _OTHER).astype(np.uint8)
        stop = (code == 46) | (code == 33) | (code == 63) | (code == 10)
        sentence = np.cumsum(stop) - stop
        keep = np.flatnonzero(kind != _SKIP)
        # a blank between two lone letters of a run of three or more is skipped
        kept = kind[keep]
        lone = np.zeros(len(kept), bool)
        if len(kept) > 2:
            lone[1:-1] = (kept[1:-1] > 0) & (kept[:-2] == 0) & (kept[2:] == 0)
            lone[0] = kept[0] > 0 and kept[1] == 0
            between = np.zeros(len(kept), bool)
            between[1:-1] = (kept[1:-1] == 0) & lone[:-2] & lone[2:]
            more = np.zeros(len(kept), bool)
            more[2:] |= between[:-2]
            more[:-2] |= between[2:]
            # letters of different sentences stay apart
            between &= more & (code[keep] != 10)
            keep = keep[~between]
            kept = kind[keep]
        self.kind = kept
        self.sentence = sentence[keep]
        start = np.zeros(len(kept), bool)
        start[1:] = (kept[1:] > 0) & (kept[:-1] == 0)
        if len(kept):
            start[0] = kept[0] > 0
        self.word = np.cumsum(start) - 1
        self.first = np.flatnonzero(start)
        bound = np.cumsum(lengths + 1)
        self.text = np.searchsorted(bound, keep[self.first], side="right")
        self.n = len(texts)

    def sizes(self):
        """Characters of each word."""
        return np.bincount(self.word[self.kind > 0], minlength=len(self.first))

    def hashes(self):
        """A 64-bit hash of each word."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        kind = self.kind[self.first[0] :]
        first = self.first - self.first[0]
        spread = np.diff(np.append(first, len(kind)))
        power = np.multiply.accumulate(np.full(int(spread.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(len(kind)) - np.repeat(first, spread)
        codes = np.where(kind > 0, mix(kind.astype(np.uint64) + np.uint64(1)), np.uint64(0))
        return mix(np.add.reduceat(codes * power[place], first))

    def spell(self, w):
        """The classes of word ``w``, as bytes."""
        a = self.first[w]
        b = self.first[w + 1] if w + 1 < len(self.first) else len(self.kind)
        return self.kind[a:b].tobytes().rstrip(b"\0")


def profile(word):
    """Triple code -> weight of one folded word."""
    out = Counter()
    for i in range(len(word)):
        for a, b in _STEPS:
            if i + b < len(word):
                out[(word[i] * _CLASSES + word[i + a]) * _CLASSES + word[i + b]] += DECAY ** (b - 2)
    return out


def _norm(p):
    return sum(v * v for v in p.values()) ** 0.5


def unit(word):
    """The profile of a word, scaled to length 1 (empty for words under three letters)."""
    p = profile(word)
    n = _norm(p)
    return {c: v / n for c, v in p.items()}


def kernel(a, b):
    """Normalised kernel of two folded words; 0 for words under three letters."""
    q = unit(b)
    return sum(v * q[c] for c, v in unit(a).items() if c in q)


class Featurizer:
    """Best kernel value of each sentence with each landmark."""

    def __init__(self, landmarks):
        shapes = [unit(w) for w in landmarks]
        codes = sorted({c for shape in shapes for c in shape})
        #: row of ``table`` of a triple code, or -1
        self.row = np.full(_CLASSES**3, -1, np.int32)
        self.row[codes] = np.arange(len(codes))
        self.table = np.zeros((len(codes), len(landmarks)), np.float32)
        for j, shape in enumerate(shapes):
            for c, v in shape.items():
                self.table[self.row[c], j] = v
        self.bound = np.zeros(_CLASSES**3)
        self.bound[codes] = self.table.max(axis=1)
        self.some = self.row >= 0

    def suspects(self, text, block=1 << 18):
        """Words that may reach ``FLOOR`` with some landmark."""
        out = []
        a = 0
        while a < len(text.first):
            b = max(a + 1, int(np.searchsorted(text.first, text.first[a] + block)))
            lo = text.first[a]
            hi = text.first[b] if b < len(text.first) else len(text.kind)
            kind = text.kind[lo:hi].astype(np.int32)
            word = text.word[lo:hi] - a
            size = np.bincount(word[kind > 0], minlength=b - a)
            reach = np.zeros(b - a)
            for s, e in _STEPS:
                if e < len(kind):
                    code = (kind[:-e] * _CLASSES + kind[s : len(kind) - e + s]) * _CLASSES + kind[e:]
                    hit = np.flatnonzero(self.some[code])
                    hit = hit[word[hit] == word[hit + e]]
                    reach += np.bincount(word[hit], self.bound[code[hit]], b - a) * DECAY ** (e - 2)
            # the norm is smallest when all triples differ
            least = sum(np.maximum(size - e, 0) * DECAY ** (2 * (e - 2)) for _, e in _STEPS)
            out.append(a + np.flatnonzero((reach > 0) & (reach >= FLOOR * np.sqrt(least) * (1 - 1e-6))))
            a = b
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def values(self, text, words, block=1 << 10):
        """Kernel values of ``words`` with every landmark; values below ``FLOOR`` are 0."""
        sizes = text.sizes()[words]
        parts = []
        for a in range(0, len(words), block):
            n = sizes[a : a + block]
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            kind = text.kind[text.first[words[a : a + block]][owner] + place].astype(np.int64)
            triples = []
            for s, e in _STEPS:
                i = np.flatnonzero(place + e < n[owner])
                code = (kind[i] * _CLASSES + kind[i + s]) * _CLASSES + kind[i + e]
                triples.append((owner[i] * _CLASSES**3 + code, np.full(len(i), DECAY ** (e - 2))))
            keys, weights = (np.concatenate(x) for x in zip(*triples))
            order = np.argsort(keys)
            keys, starts = np.unique(keys[order], return_index=True)
            weights = np.add.reduceat(weights[order], starts) if len(keys) else np.zeros(0)
            owner, code = np.divmod(keys, _CLASSES**3)
            norm = np.sqrt(np.bincount(owner, weights**2, len(n)))
            hit = np.flatnonzero(self.some[code])
            out = np.zeros((len(n), self.table.shape[1]), np.float32)
            if len(hit):
                first = np.flatnonzero(np.diff(owner[hit], prepend=-1))
                rows = self.table[self.row[code[hit]]] * weights[hit, None].astype(np.float32)
                out[owner[hit[first]]] = np.add.reduceat(rows, first, axis=0)
            out /= np.maximum(norm, 1e-9)[:, None].astype(np.float32)
            out[out < FLOOR] = 0
            out **= POWER
            parts.append(out)
        return np.concatenate(parts) if parts else np.zeros((0, self.table.shape[1]), np.float32)

    def all_sentences(self, texts, limit=1 << 18):
        """:meth:`sentences` of many texts, a bounded number of characters at a time."""
        owners, rows = [np.zeros(0, np.int64)], [np.zeros((0, self.table.shape[1]), np.float32)]
        for a, b in groups_of([len(t) for t in texts], limit):
            owner, x = self.sentences(texts[a:b])
            owners.append(owner + a)
            rows.append(x)
        return np.concatenate(owners), np.concatenate(rows)

    def sentences(self, texts):
        """Text number and features of every sentence with a suspicious word."""
        text = Text(texts)
        words = self.suspects(text)
        _, index, back = np.unique(text.hashes()[words], return_index=True, return_inverse=True)
        values = self.values(text, words[index])
        kept = np.flatnonzero(values.any(axis=1)[back])
        words, values = words[kept], values[back[kept]]
        first = np.flatnonzero(np.diff(text.sentence[text.first[words]], prepend=-1))
        if not len(first):
            return np.zeros(0, np.int64), np.zeros((0, values.shape[1]), np.float32)
        return text.text[words[first]], np.maximum.reduceat(values, first, axis=0)


def _parts(texts, limit=1 << 18):
    """The texts, folded, a bounded number of characters at a time (one text at least)."""
    for a, b in groups_of([len(t) for t in texts], limit):
        yield Text(texts[a:b])


def choose_landmarks(toxic, clean, most):
    """Words used in the most surroundings of toxic texts and (nearly) none of clean ones."""

    def surroundings(texts):
        """Hash of each word -> number of different (word before, word after)."""
        parts = []
        for text in _parts(texts):
            words = text.hashes()
            if len(words):
                edge = np.zeros(len(words), bool)
                edge[1:] = text.text[1:] != text.text[:-1]
                before = np.where(edge, np.uint64(1), np.roll(words, 1))
                after = np.where(np.roll(edge, -1), np.uint64(1), np.roll(words, -1))
                long = text.sizes() > 3
                pair = mix(mix(before + mix(words)) + after)[long]
                _, index = np.unique(pair, return_index=True)
                parts.append((pair[index], words[long][index]))
        if not parts:
            return {}
        _, index = np.unique(np.concatenate([p for p, _ in parts]), return_index=True)
        kinds, counts = np.unique(np.concatenate([w for _, w in parts])[index], return_counts=True)
        often = counts >= 3
        return dict(zip(kinds[often].tolist(), counts[often].tolist()))

    bad, good = surroundings(toxic), surroundings(clean)
    share = len(toxic) / max(1, len(clean))
    odds = {w: n - 8 * share * good.get(w, 0) for w, n in bad.items()}
    least = max(3, 0.003 * len(toxic))
    ranked = sorted((w for w in odds if odds[w] >= least), key=lambda w: (-odds[w], w))[: 8 * most]
    spelled_as = {}
    for text in _parts(toxic):
        words = text.hashes()
        found, index = np.unique(words, return_index=True)
        for w, i in zip(found.tolist(), index.tolist()):
            if w in odds and w not in spelled_as:
                spelled_as[w] = text.spell(i)
    chosen, shapes = [], []
    for w in ranked:
        if len(chosen) == most:
            break
        spelled = spelled_as[w]
        shape = unit(spelled)
        if all(sum(v * x.get(c, 0.0) for c, v in shape.items()) < 0.85 for x in shapes):
            chosen.append(spelled)
            shapes.append(shape)
    return chosen


def fit_svm(x, y, cost=3000.0, rounds=50):
    """Weights of a linear squared-hinge SVM (last weight: bias), by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    # both classes weigh the same
    c = cost * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) / 100
    ridge = np.eye(x.shape[1]) / len(y)
    ridge[-1, -1] *= 1e-3
    w, active = np.zeros(x.shape[1]), np.ones(len(y), bool)
    for _ in range(rounds):
        a, t = x[active], y[active]
        weighed = (a * c[active, None]).T
        w = np.linalg.solve(ridge + weighed @ a, weighed @ t)
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


@dataclass
class Model:
    """Landmarks, weights on their kernel values, and the calibration of the decision."""

    landmarks: list
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, texts, featurizer=None):
        """Scores between 0 and 1."""
        featurizer = featurizer or Featurizer(self.landmarks)
        worst = np.full(len(texts), self.bias)
        owner, x = featurizer.sentences(texts)
        np.maximum.at(worst, owner, x @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -500, 500)))


def _padded(landmarks):
    """Each longer landmark with a letter pushed in, at two places, several times over."""
    words = ["".join(chr(96 + c) if c < 27 else "ß" for c in w) for w in landmarks if len(w) > 4]
    return [w[:i] + "x" + w[i:] for w in words for i in (len(w) // 2, len(w) - 1)] * 8


def fit(toxic, clean, landmarks=96):
    """A ``Model`` from two lists of texts, or None if they show no difference."""
    chosen = choose_landmarks(toxic, clean, landmarks)
    if not chosen:
        return None
    featurizer = Featurizer(chosen)
    shapes = [unit(w) for w in chosen]
    gram = np.array([[sum(v * b.get(c, 0.0) for c, v in a.items()) for b in shapes] for a in shapes]) ** POWER
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 1e-3 * values.max())
    root = (vectors @ np.diag(values**-0.5) @ vectors.T).astype(np.float32)
    bad_owner, bad = featurizer.all_sentences(toxic)
    good_owner, good = featurizer.all_sentences(clean)
    # clean texts also have sentences without suspicious words
    good = np.vstack([good, np.zeros((max(1, len(clean) // 4), len(chosen)), np.float32)]) @ root
    near = bad.max(axis=1, initial=0) >= 0.9**POWER
    bad = bad @ root
    padded = featurizer.sentences(_padded(chosen))[1] @ root
    pick = np.zeros(len(bad))
    for _ in range(4):
        worst = np.full(len(toxic), -np.inf)
        np.maximum.at(worst, bad_owner, pick)
        chosen_rows = (pick >= worst[bad_owner]) | near
        x = np.vstack([bad[chosen_rows], padded, good])
        y = np.concatenate([np.ones(chosen_rows.sum() + len(padded)), -np.ones(len(good))])
        w = fit_svm(x, y)
        pick = bad @ w[:-1] + w[-1]
    model = Model(chosen, root @ w[:-1], float(w[-1]), 1.0, 0.0)
    decision, label = [], []
    for owner, rows, n, kind in ((bad_owner, bad, len(toxic), 1), (good_owner, good[: len(good_owner)], len(clean), 0)):
        worst = np.full(n, w[-1])
        np.maximum.at(worst, owner, rows @ w[:-1] + w[-1])
        decision.append(worst)
        label.append(np.full(n, kind))
    model.slope, model.shift = _calibrate(np.concatenate(decision), np.concatenate(label))
    return model


def _calibrate(decision, label):
    """Slope and shift of the logistic curve through ``decision`` (Platt's targets)."""
    pos, neg = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(label == 1, 0.5 / max(1, pos), 0.5 / max(1, neg))
    z = np.column_stack([decision, np.ones(len(decision))])
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - target)) + 1e-5 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-5 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    # the curve keeps its slope and passes THRESHOLD where the classes separate best
    order = np.argsort(decision)
    kind = label[order]
    below = np.concatenate(([0], np.cumsum(kind == 1))) / max(1, pos)
    above = (neg - np.concatenate(([0], np.cumsum(kind == 0)))) / max(1, neg)
    k = int(np.argmin(below + 10 * above))
    edge = decision[order]
    cut = (edge[max(k - 1, 0)] + edge[min(k, len(edge) - 1)]) / 2
    return float(w[0]), float(np.log(THRESHOLD / (1 - THRESHOLD)) - w[0] * cut)


def training_sample(docs, labels, per_class=2000):
    """Texts of at most ``per_class`` labelled documents of each class, as two lists."""
    marked = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    # the bound is on rows; ids first, so that only chosen texts are read and moved
    chosen = None
    for kind in (1, 0):
        part = marked.filter(F.col("label") == kind).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class narrow rows: a bounded broadcast
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("label", F.col("text").cast("string").alias("text")).collect()
    return tuple([r["text"] or "" for r in rows if r["label"] == kind] for kind in (1, 0))


def score_texts(docs, model, threshold=THRESHOLD, keep=()):
    """``docs`` columns ``keep`` with ``score`` and ``predicted``."""
    frame = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").cast("string").alias("text"))
    at = frame.columns.index("text")
    shown = frame if "text" in keep else frame.drop("text")
    schema = shown.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches):
        featurizer = Featurizer(model.landmarks) if model else None
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
            score = np.zeros(len(texts))
            for a, b in groups_of([len(t) for t in texts], 1 << 21):
                if model:
                    score[a:b] = model.score(texts[a:b], featurizer)
            predicted = pa.array((score >= threshold).astype(np.int32))
            columns = batch.columns if len(schema) == len(batch.columns) + 2 else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), predicted], schema.names)

    return frame.mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    """Rows kept out of training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs, labels, per_class=2000, landmarks=96):
    """Fit on labelled rows that are not held out."""
    return fit(*training_sample(docs, labels.filter(~held_out()), per_class), landmarks)
