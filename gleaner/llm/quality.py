"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection are measured on a bounded sample; rules then
run by falling rejection per cost, and a text stops at the first that rejects
it. Statistics are worked out when a rule asks for them, so that a text that
goes early costs little. The order changes the work alone: a text is kept if
no rule rejects it.
"""

from __future__ import annotations

import operator
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

#: Rows on which costs and rejections are measured, and the longest text there.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 50_000

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more.

    Windows are named exactly, by doubling: names of windows of 1, 2, 4 and 8
    words, each from the pair of its halves. ``window`` is a power of 2.
    """
    n = len(words)
    if n <= window:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    if len(names) == n:
        return 0
    counts = None
    width = 1
    while width < window:
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
        width *= 2
    twice = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[twice] += 1
    np.subtract.at(edges, twice + window, 1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


class Text:
    """A text whose statistics are worked out when a rule first asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """The lines that hold a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    def known(self) -> "Text":
        """A second one that has worked out as much as this."""
        out = Text(self.text)
        out.__dict__.update(self.__dict__)
        return out


def has_letter(word: bytes) -> bool:
    return word.lower() != word.upper() or not word.isascii() and any(map(str.isalpha, word.decode("utf-8", "surrogatepass")))


def _odd_lines(t: Text) -> bool:
    ends = sum(1 for x in t.lines if x.rstrip(SPACES).endswith(("...", "…")))
    bullets = sum(1 for x in t.lines if x.lstrip(SPACES).startswith(("•", "- ", "* ")))
    return 10 * ends > 3 * len(t.lines) or 10 * bullets > 9 * len(t.lines)


#: The rules of the contract's base, then the others; a test returns True to reject.
BASE: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < LEAST_WORDS,
    "repeats": lambda t: 100 * t.n_repeat_words > MOST_REPEATED_PERCENT * t.n_words,
}
RULES: dict[str, Callable[[Text], bool]] = BASE | {
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "dup_lines": lambda t: t.n_dup_lines > 2 and 100 * t.n_dup_lines > 30 * len(t.lines),
    "word_runs": lambda t: 10 * sum(map(operator.eq, t.words, t.words[1:])) > 3 * t.n_words,
    "few_letters": lambda t: 10 * sum(map(has_letter, t.words)) < 7 * t.n_words,
    "odd_lines": _odd_lines,
}


def plan(texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) in the order to run them.

    Each place goes to the rule that rejects most per cost among the texts
    that the rules before it let through, given the statistics that those have
    worked out already. Where no text is left, cost alone decides.
    """
    left, out, waiting = [Text(t) for t in texts], [], list(RULES)
    every = [Text(t) for t in texts]
    while waiting:
        tried = left or every
        measured = []
        for name in waiting:
            fresh = [t.known() for t in tried]
            began = time.perf_counter()
            rejected = sum(map(RULES[name], fresh))
            measured.append((name, (time.perf_counter() - began) / max(1, len(fresh)), rejected / max(1, len(fresh)) if left else 0.0))
        best = min(measured, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1], x[0]))
        out.append(best)
        waiting.remove(best[0])
        left = [t for t in left if not RULES[best[0]](t)]
    return out


def passes(t: Text, order: list[str]) -> bool:
    """Whether no rule rejects the text; the first that does ends it."""
    return not any(RULES[name](t) for name in order)


FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(),
}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(text: str | None, order: list[str]) -> tuple:
    """The columns of FIELDS: the cascade's verdict, and the statistics that every row reports."""
    t = Text(text)
    kept = passes(t, order)
    return t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, not kept and any(rule(t) for rule in BASE.values()), kept


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """The order of the rules, by a bounded sample of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    sample = sampled(rows.filter(F.length("__text") <= SAMPLE_CHARS), docs.count(), SAMPLE_ROWS, "doc_id", "__text")
    return [name for name, _, _ in plan([r[1] for r in sample.collect()])]


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that a rule rejects; of a text no more is worked out than its verdict takes. Null texts go."""
    order = fitted(docs, id_col, text_col)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([passes(Text(t), order) for t in texts], dtype="bool")

    return docs.filter(good(F.col(text_col)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, the base statistics, base_failed and kept.

    Nulls: a null text counts as empty, fails the base rules and is not kept;
    a null id is kept as it is. Repeated rows each get their row; extra
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    order = fitted(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(t.as_py(), order) for t in batch.column(1)]
            columns = zip(*out) if out else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(columns, FIELDS.values()))], ["doc_id", *FIELDS]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
