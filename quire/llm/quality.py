"""Line-first quality rules: judge lines, drop the bad ones, reject what loses too much.

Every line of a document is judged on its own. A line fails

- ``boilerplate``: it equals an earlier line of its document;
- ``navigation``: it holds symbols (``#*$%&|<>``) for more than ``symbol_share`` of its
  words, or has fewer than ``few_words`` words and no sentence end;
- ``punctuation``: it has ``many_words`` words or more and no punctuation at all;
- ``shouting``: more than ``upper_share`` of its ASCII letters are capitals (from
  ``few_words`` words on);
- ``repetition``: more than ``repeat_share`` of its words lie in three-word windows that
  occurred before in the text.

What is left is the cleaned text. A document is kept if it passes the base checks and
loses at most ``max_loss`` of its words. Lines are parts between ``\\n``; lines without a
word are neither judged nor counted.

All counts cover whole texts, one Arrow batch at a time in slices of a bounded size (one
text at least); nothing is shuffled. Nulls: a null text is empty, an empty text has zero
counts, fails the base checks and is not kept. Null ids and repeated rows pass through
one by one; extra columns are ignored; an empty table gives no rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from quire.llm.words import Batch, mix, slices

COUNTS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_failed_lines long, n_kept_words long, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the verdict."""

    symbol_share: float = 0.3
    few_words: int = 4
    many_words: int = 10
    upper_share: float = 0.5
    repeat_share: float = 0.5
    max_loss: float = 0.5
    least_words: int = 50


def _flags(chars):
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL = _flags("#*$%&|<>")
_MARK = _flags(".,;:!?")
_END = _flags(".!?:;\"')")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _flags("abcdefghijklmnopqrstuvwxyz")


def _running(flags):
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _covered(starts, n):
    """Which of ``n`` words lie in a three-word window that begins at one of ``starts``."""
    step = np.zeros(n + 4, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + 3, -1)
    return np.cumsum(step[:n]) > 0


def _earlier_lines(text):
    """Numbers of the lines that hold a word and equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return ()
    seen, out = set(), []
    for i, line in enumerate(lines):
        if line in seen:
            if line.strip(" \t\n\r\x0b\x0c"):
                out.append(i)
        else:
            seen.add(line)
    return out


def judge(texts, rules):
    """Counts per text, and per line its text, byte bounds, word count and whether it failed."""
    b = Batch(texts)
    n, words = b.n, len(b.start)
    # every text starts a line, every \n another one
    breaks = np.flatnonzero(b.buf == 10)
    line_start = np.sort(np.concatenate((b.off[:-1], breaks + 1)), kind="stable")
    first_line = np.searchsorted(breaks, b.off[:-1]) + np.arange(n)
    n_lines = len(line_start)
    line_text = np.repeat(np.arange(n), np.diff(np.append(first_line, n_lines)))
    line_end = np.append(line_start[1:], len(b.buf)) if n_lines else line_start
    word_line = np.searchsorted(breaks, b.start) + b.text
    per_line = np.bincount(word_line, minlength=n_lines)

    runs, inside = b.runs(3)
    at = np.flatnonzero(inside)
    _, first, back, counts = np.unique(
        mix(runs[at] + mix(b.text[at].astype(np.uint64))), return_index=True, return_inverse=True, return_counts=True
    )
    repeated = _covered(at[counts[back] > 1], words)
    repeats = _covered(at[first[back] != np.arange(len(at))], words)

    symbols, points = _running(_SYMBOL[b.buf]), _running((b.buf & 0xC0) != 0x80)
    marks, upper, letters = _running(_MARK[b.buf]), _running(_UPPER[b.buf]), _running(_LETTER[b.buf])
    of = lambda running: running[line_end] - running[line_start]
    first_word = np.searchsorted(word_line, np.arange(n_lines))
    last_word = first_word + per_line - 1
    ends = np.zeros(n_lines, bool)
    has = per_line > 0
    ends[has] = _END[b.buf[b.end[last_word[has]] - 1]]

    duplicate = np.zeros(n_lines, bool)
    for i, text in enumerate(texts.to_pylist()):
        if text:
            for k in _earlier_lines(text):
                duplicate[first_line[i] + k] = True
    failed = (
        duplicate
        | (of(symbols) > rules.symbol_share * per_line)
        | ((per_line < rules.few_words) & ~ends)
        | ((per_line >= rules.many_words) & (of(marks) == 0))
        | ((per_line >= rules.few_words) & (of(upper) > rules.upper_share * np.maximum(of(letters), 1)))
        | (np.bincount(word_line, repeats, n_lines) > rules.repeat_share * per_line)
    ) & has

    total = lambda values, index: np.bincount(index, values, n).astype(np.int64)
    n_repeat = total(repeated, b.text)
    kept_words = total(per_line * ~failed, line_text)
    base = (b.counts < rules.least_words) | (100 * n_repeat > 50 * b.counts)
    columns = [
        b.counts.astype(np.int64),
        total(points[b.end] - points[b.start], b.text),
        symbols[b.off[1:]] - symbols[b.off[:-1]],
        total(duplicate, line_text),
        n_repeat,
        total(has, line_text),
        total(failed, line_text),
        kept_words,
        base,
        ~base & (b.counts - kept_words <= rules.max_loss * b.counts),
    ]
    return b, columns, (line_text, line_start, line_end, failed)


def judge_documents(docs, rules=Rules(), with_text=False):
    """Rows of ``COUNTS``; ``with_text`` adds ``clean_text``, the lines that passed, joined by ``\\n``."""
    schema = COUNTS + (", clean_text string" if with_text else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                texts = pc.fill_null(part.column(1), "")
                b, columns, (line_text, start, end, failed) = judge(texts, rules)
                arrays = [part.column(0), *map(pa.array, columns)]
                if with_text:
                    clean = [[] for _ in range(b.n)]
                    for i in np.flatnonzero(~failed):
                        clean[line_text[i]].append(b.buf[start[i] : end[i]].tobytes().rstrip(b"\n"))
                    arrays.append(pa.array([b"\n".join(x).decode() for x in clean], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
