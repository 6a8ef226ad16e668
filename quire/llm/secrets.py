"""Secrets: fixed patterns, and formats inferred from what they label.

*Labelled credentials* are the values the fixed patterns find: what is assigned to a key
word, access keys, long hexadecimal strings. For each kind a probabilistic automaton is
inferred from them:

- the values form a prefix tree over *shapes*: a run of letters and digits is a run of one
  symbol, every other sign is its own. Spark counts the nodes (values that pass and end there)
  and, per node, the characters that come next, so a fixed beginning such as ``AKIA`` or a
  hexadecimal middle part shows in the characters of its positions;
- states of the tree are merged when they are statistically compatible: the shares of values
  that end, of each next character and of each class of characters differ by less than
  Hoeffding's bound, and so do those of all states behind them. Merged states share their
  counts, so formats of a fixed length keep a chain, formats of any length get a loop;
- characters are emitted by the state they leave, smoothed with all characters of the kind.

*Candidates* are runs of 12 or more credential characters with a letter and a digit outside
all base spans. A candidate's score is its log likelihood a character under the automaton of
a kind. It is a secret if that is not below the ``quantile`` of labelled values which the
automaton was not inferred from, and beats ordinary text (shares of characters and ends of
runs, counted over all texts) by ``margin`` nats a character. The best kind wins. (Shares, not
pairs of characters: letters after digits stand in little else than secrets, which pairs
would therefore take for ordinary.)

Texts are read twice (spans; character pairs). Automata are fitted on at most ``sample``
distinct values a kind, of 200 characters or fewer (by hash order); only node counts of that
sample and one table of character counts reach the driver. Everything else covers all rows and
whole texts: a text's matches are found in its task, whatever its length.

Nulls: a null text is empty; a null ``doc_id`` is kept; repeated rows are rows of their own.
Spans of different kinds may overlap and are listed by start, then kind; candidates overlap
nothing. Only ``doc_id`` and ``text`` are read, so extra columns cannot clash. An empty table
gives no rows; kinds without labelled values get no automaton.
"""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.words import slices

KINDS = ("assign", "access", "hex")
_any_case = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_KEY = "|".join(_any_case(k) for k in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = re.compile(rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{12,}")
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=-"
END = ""
_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(LETTERS.encode())] = True
SPAN = "struct<start:int,kind:int,end:int>"
FOUND = f"doc_id long, base array<{SPAN}>, labelled array<struct<kind:int,value:string>>, candidates array<struct<start:int,end:int,value:string>>"


def base_matches(text):
    """``(start, kind number, end, value)`` of the fixed patterns, by start, then kind.

    A run of too few characters is dropped without another try; for the two simple patterns
    that equals asking for the length at once, because a later start only gives a shorter run.
    """
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), k, m.end(), m[0]) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    return sorted(out)


def candidates_of(text, base):
    """Runs with a letter and a digit that touch no base span: ``(start, end, value)``."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        value = m[0].strip("+/_.=-")
        a = m.start() + m[0].index(value)
        b = a + len(value)
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a and b - a >= 12 and not value.isalpha() and re.search("[A-Za-z]", value) and re.search("[0-9]", value):
            out.append((a, b, value))
    return out


def found_in(docs):
    """Base spans, labelled values and candidates of every row (``FOUND``)."""

    def run(batches):
        for whole in batches:
            for part in slices(whole, whole.column("text")):
                base, labelled, more = [], [], []
                for text in part.column("text").to_pylist():
                    hits = base_matches(text or "")
                    base.append([{"start": a, "kind": k, "end": b} for a, k, b, _ in hits])
                    labelled.append([{"kind": k, "value": v} for _, k, _, v in hits])
                    more.append([{"start": a, "end": b, "value": v} for a, b, v in candidates_of(text or "", hits)])
                i32 = pa.int32()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(base, pa.list_(pa.struct([("start", i32), ("kind", i32), ("end", i32)]))),
                        pa.array(labelled, pa.list_(pa.struct([("kind", i32), ("value", pa.string())]))),
                        pa.array(more, pa.list_(pa.struct([("start", i32), ("end", i32), ("value", pa.string())]))),
                    ],
                    ["doc_id", "base", "labelled", "candidates"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, FOUND)


def character_shares(docs):
    """Log share of each credential character, and of the end of a run, in all texts."""

    def count(batches):
        n = np.zeros(256, np.int64)
        for whole in batches:
            for part in slices(whole, whole.column("text")):
                # one sign that is in no run ends every text
                at = np.frombuffer("\n".join(t or "" for t in part.column("text").to_pylist()).encode() + b"\n", np.uint8)
                run = _IN_RUN[at]
                n += np.bincount(at[run], minlength=256)
                n[10] += np.count_nonzero(run[:-1] & ~run[1:])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["code", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "code long, n long")
    counts = {chr(r["code"]): r["n"] for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    counts = {ch: counts.get(ch or "\n", 0) + 1 for ch in [*LETTERS, END]}
    return {ch: math.log(n / sum(counts.values())) for ch, n in counts.items()}


def shape(ch):
    return "x" if ch.isalnum() else ch


def kind_of_sign(ch):
    """Class of a character for the statistical test."""
    return "digit" if ch.isdigit() else "hex" if ch in "abcdef" else "lower" if ch.islower() else "upper" if ch.isupper() else "sign"


class State:
    """Counts of a state: values that end here, characters that leave it, successors by shape."""

    def __init__(self):
        self.out, self.next = Counter(), {}

    @property
    def total(self):
        return sum(self.out.values())


def prefix_tree(counts):
    """The root of the tree for ``(prefix shape, next character or END) -> n``."""
    root = State()
    for prefix, n in sorted(counts.items()):
        state = root
        for s in prefix:
            state = state.next.setdefault(s, State())
        state.out.update(n)
    return root


def _differ(a, b, alpha):
    """Whether two states' shares are further apart than Hoeffding's bound allows."""
    n, m = a.total, b.total
    if not n or not m:
        return False
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    groups = defaultdict(float)
    for state, total, sign in ((a, n, 1), (b, m, -1)):
        for ch, k in state.out.items():
            groups[ch] += sign * k / total
            if ch:
                groups[kind_of_sign(ch)] += sign * k / total
                groups[("shape", shape(ch))] += sign * k / total
    return any(abs(g) > bound for g in groups.values())


def compatible(a, b, alpha):
    """Whether two states and all states behind them agree."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if a is b:
            continue
        if _differ(a, b, alpha):
            return False
        todo += [(a.next[s], b.next[s]) for s in a.next.keys() & b.next.keys()]
    return True


def _fold(into, tree):
    """Add the counts of a tree to a part of the automaton, opening new states where it has none."""
    todo = [(into, tree)]
    while todo:
        a, b = todo.pop()
        if a is b:
            continue
        a.out.update(b.out)
        for s, state in b.next.items():
            if s in a.next:
                todo.append((a.next[s], state))
            else:
                a.next[s] = state


def infer(counts, alpha=0.01):
    """Merge compatible states of the prefix tree; returns the settled states, the first one first."""
    settled = [prefix_tree(counts)]
    edge = [(settled[0], s) for s in sorted(settled[0].next)]
    while edge:
        # the state most values pass is judged first: its shares are the surest
        edge.sort(key=lambda e: e[0].next[e[1]].total)
        source, s = edge.pop()
        state = source.next[s]
        if any(state is r for r in settled):
            continue
        for red in settled:
            if compatible(red, state, alpha):
                source.next[s] = red
                _fold(red, state)
                break
        else:
            settled.append(state)
        known = set(map(id, settled))
        edge = [(r, t) for r in settled for t in sorted(r.next) if id(r.next[t]) not in known]
    return settled


def tables(settled):
    """An automaton as plain tables: per state the log probability of each character and of the end, and successors."""
    number = {id(r): i for i, r in enumerate(settled)}
    overall = Counter()
    for r in settled:
        overall.update(r.out)
    every = sum(overall.values())
    share = {ch: (overall[ch] + 0.05) / (every + 0.05 * (len(LETTERS) + 1)) for ch in [*LETTERS, END]}
    logs, moves = [], []
    for r in settled:
        n = r.total
        logs.append({ch: math.log((r.out[ch] + share[ch]) / (n + 1)) for ch in share})
        moves.append({s: number[id(t)] for s, t in r.next.items()})
    # a way no labelled value took leads to a state in which nothing is likelier than anything else
    logs.append({ch: -math.log(len(share)) for ch in share})
    moves.append({})
    return logs, moves


def likelihood(automaton, value):
    """Log likelihood a character of ``value``, its end included."""
    logs, moves = automaton
    at, total = 0, 0.0
    for ch in value:
        total += logs[at][ch]
        at = moves[at].get(shape(ch), len(logs) - 1)
    return (total + logs[at][END]) / (len(value) + 1)


def ordinary(shares, value):
    """Log likelihood a character of ``value`` as a run of ordinary text."""
    return (sum(shares[ch] for ch in value) + shares[END]) / (len(value) + 1)


def learn(found, sample=4000, support=3, quantile=0.05, alpha=0.01):
    """``{kind: (automaton, threshold)}`` from the labelled values of ``found``.

    Three values in four build the tree; the rest sets the threshold (all do both jobs where
    there are fewer than 20). Nodes that fewer than ``support`` values pass are left out.
    """
    values = found.select(F.explode("labelled").alias("v")).select("v.kind", "v.value").filter(F.length("value") <= 200)
    # copies of a text hold the same secret: each value counts once
    values = values.groupBy("kind", "value").agg(F.xxhash64("value").alias("h"))
    picked = None
    for k in range(len(KINDS)):
        one = values.filter(F.col("kind") == k).orderBy("h", "value").limit(sample)
        picked = one if picked is None else picked.unionByName(one)
    picked = stored(picked.withColumn("held", F.pmod("h", F.lit(4)) == 0), "secrets-labelled")
    sizes = {r["kind"]: r["n"] for r in picked.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    few = [k for k, n in sizes.items() if n < 20]
    tree = picked.filter(~F.col("held") | F.col("kind").isin(few)) if few else picked.filter(~F.col("held"))
    shapes = F.regexp_replace("value", "[A-Za-z0-9]", "x")
    steps = tree.select("kind", "value", shapes.alias("shape"), F.explode(F.sequence(F.lit(0), F.length("value"))).alias("i"))
    steps = steps.select("kind", F.substring("shape", F.lit(1), F.col("i")).alias("prefix"), F.substring("value", F.col("i") + 1, F.lit(1)).alias("ch"))
    counts = defaultdict(lambda: defaultdict(Counter))
    for r in steps.groupBy("kind", "prefix", "ch").agg(F.count("*").alias("n")).collect():
        counts[r["kind"]][r["prefix"]][r["ch"]] += r["n"]
    model = {}
    for k, nodes in counts.items():
        automaton = tables(infer({p: c for p, c in nodes.items() if sum(c.values()) >= support}, alpha))
        checks = picked.filter(F.col("kind") == k) if k in few else picked.filter((F.col("kind") == k) & F.col("held"))
        scores = sorted(likelihood(automaton, r["value"]) for r in checks.select("value").collect())
        if scores:
            model[k] = automaton, scores[int(len(scores) * quantile)]
    return model


def judged(found, model, shares, margin=1.0):
    """``found`` with ``spans``: the base spans and those of convincing candidates."""

    def verdict(value):
        usual, best = ordinary(shares, value), None
        for k, (automaton, least) in sorted(model.items()):
            score = likelihood(automaton, value)
            if score >= least and score - usual >= margin and (best is None or score > best[0]):
                best = score, k
        return best

    def run(batches):
        for batch in batches:
            spans = []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist()):
                for c in more:
                    best = verdict(c["value"])
                    if best:
                        base.append({"start": c["start"], "kind": best[1], "end": c["end"]})
                spans.append(sorted(base, key=lambda s: (s["start"], s["kind"])))
            columns = [batch.column("doc_id"), batch.column("base"), pa.array(spans, batch.schema.field("base").type)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "spans"])

    return found.select("doc_id", "base", "candidates").mapInArrow(run, f"doc_id long, base array<{SPAN}>, spans array<{SPAN}>")


def find(docs, sample=4000, support=3, quantile=0.05, alpha=0.01, margin=1.0):
    """``doc_id``, ``base`` and ``spans``: arrays of (start, kind number, end), in order."""
    found = stored(found_in(docs), "secrets-found")
    return judged(found, learn(found, sample, support, quantile, alpha), character_shares(docs), margin)


def written(spans):
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
