"""Benchmark decontamination by BM25 with block-max WAND.

Test items are indexed: for every term its items in order, in blocks, each
with its highest BM25 weight. Every training text is cut into passages that
overlap by half; each passage is a query that retrieves all items scoring
above a threshold. List maxima and block maxima, summed up for many passages at
once, rule most passages out, pivots and block maxima most items. What is
retrieved counts only if the passage holds the words of the item's question in
order, and those of its answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Usual constants of BM25.
K1, B = 1.2, 0.75

#: Items in a block. Blocks are ranges of items, the same for every term, so
#: that their maxima add up over terms.
BLOCK = 4

#: Share of an item's score with itself that a passage must reach.
THRESHOLD = 0.6

#: Share of an item's words that must be found in order, and of this share what
#: question and answer must each reach.
OVERLAP, EACH = 0.8, 0.75

#: Words of a text in which they must be found, over the words of question or answer.
SPREAD = 1.5

#: Words of an item that count as its answer where it has one sentence.
ANSWER_PART = 0.25

#: An item longer than its class's shortest by this factor starts a class.
CLASS_GROWTH = 1.25

#: Bytes of test items that the index is built for, held by every task. Larger
#: tables are indexed and searched in groups of this size.
INDEX_BYTES = 32 << 20

#: Words, postings and sums that are worked on at once; bounds a worker's memory.
PART_SIZE = 1 << 18

SENTENCE = re.compile(rb"(?<=[.!?])\s+")

#: ASCII that isn't a letter or digit parts words.
PARTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(PARTS).split()


def question_words(text: bytes) -> int:
    """How many words come before the answer: the last sentence, else the last part."""
    sentences = [n for x in SENTENCE.split(text) if (n := len(words_of(x)))]
    total = sum(sentences)
    if len(sentences) > 1:
        return total - sentences[-1]
    return total - max(1, round(total * ANSWER_PART)) if total > 1 else 0


class Postings:
    """A term's items in order and their weights; its blocks, each block's last item and highest weight."""

    def __init__(self, items: list[int], weights: list[float]):
        self.items, self.weights = items, weights
        cuts = [k for k in range(len(items)) if not k or items[k] // BLOCK != items[k - 1] // BLOCK]
        ends = [*cuts[1:], len(items)]
        self.cuts = cuts
        self.blocks = np.array([items[k] // BLOCK for k in cuts], np.int64)
        self.last = [items[e - 1] for e in ends]
        self.highest = [max(weights[k:e]) for k, e in zip(cuts, ends)]
        self.maxima = np.array(self.highest)
        self.most = max(self.highest)


class Cursor:
    def __init__(self, postings: Postings):
        self.postings, self.at, self.block = postings, 0, 0
        self.item = postings.items[0]

    def seek(self, item: int) -> None:
        """To the first posting not before ``item``; blocks before it are skipped."""
        p = self.postings
        if self.item >= item:
            return
        self.shallow(item)
        self.at = max(self.at, p.cuts[self.block] if self.block < len(p.cuts) else len(p.items))
        while self.at < len(p.items) and p.items[self.at] < item:
            self.at += 1
        self.item = p.items[self.at] if self.at < len(p.items) else END

    def shallow(self, item: int) -> float:
        """Move to the block that may hold ``item``, and return its highest weight."""
        p = self.postings
        while self.block < len(p.last) and p.last[self.block] < item:
            self.block += 1
        return p.highest[self.block] if self.block < len(p.last) else 0.0

    @property
    def weight(self) -> float:
        return self.postings.weights[self.at]


END = 1 << 62

#: Sums in another order differ by less.
SLACK = 1e-9


@dataclass(frozen=True)
class Totals:
    """Of all items with words: how many, their mean length, terms' document frequencies, and the longest of each length class."""

    n: int
    mean: float
    df: Mapping[bytes, int]
    longest: list[int]


def totals(lengths: Mapping[int, int], df: Mapping[bytes, int]) -> Totals:
    """``lengths``: how many items have each number of words."""
    n = sum(lengths.values())
    longest: list[int] = []
    for k in sorted(lengths):
        if not longest or k > CLASS_GROWTH * shortest:
            shortest = k
            longest.append(k)
        longest[-1] = k
    return Totals(n, sum(k * c for k, c in lengths.items()) / max(1, n), df, longest)


@dataclass(frozen=True)
class Blocks:
    """Block maxima of a class's terms, one term after the other; term ``t`` has those from ``starts[t]`` to ``starts[t + 1]``."""

    starts: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    most: np.ndarray
    first: int  # block of the class
    n: int

    @classmethod
    def of(cls, postings: Mapping[int, Postings], terms: int) -> "Blocks":
        counts, most = np.zeros(terms + 2, np.int64), np.zeros(terms + 1)
        listed = sorted(postings)
        for t in listed:
            counts[t + 1], most[t] = len(postings[t].blocks), postings[t].most
        blocks = np.concatenate([postings[t].blocks for t in listed]) if listed else np.zeros(0, np.int64)
        maxima = np.concatenate([postings[t].maxima for t in listed]) if listed else np.zeros(0)
        first = int(blocks.min()) if len(blocks) else 0
        return cls(np.cumsum(counts), blocks - first, maxima, most, first, int(blocks.max()) - first + 1 if len(blocks) else 0)


class Index:
    """BM25 weights of the items' terms, each divided by its item's score with itself.

    So one threshold serves all items. Items stand in order of length and fall
    into classes of about equal length; a class has posting lists and a length
    of passages of its own. Items without words are left out. ``of`` are the
    totals where ``items`` are a part of a table.
    """

    def __init__(self, items: list[tuple[object, bytes]], of: Totals | None = None):
        rows = sorted(((len(words), i, item_id, text) for i, (item_id, text) in enumerate(items) if (words := words_of(text))), key=lambda x: x[:2])
        self.texts = [r[3] for r in rows]
        self.lengths = [r[0] for r in rows]
        self.ids = [r[2] for r in rows]
        self.questions = [question_words(t) for t in self.texts]
        own_df = Counter(w for t in self.texts for w in set(words_of(t)))
        of = of or totals(Counter(r[0] for r in rows), own_df)
        n, mean, df = of.n, of.mean, of.df
        self.terms = {w: k for k, w in enumerate(own_df)}
        self.longest = of.longest
        lists: list[dict[int, list[tuple[int, float]]]] = [{} for _ in self.longest]
        for i, text in enumerate(self.texts):
            words = words_of(text)
            postings = lists[bisect_left(self.longest, len(words))]
            norm = K1 * (1 - B + B * len(words) / mean)
            weights = {
                w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(words).items()
            }
            own = sum(weights.values())
            for w, x in weights.items():
                postings.setdefault(self.terms[w], []).append((i, x / own))
        self.postings = [{t: Postings(*map(list, zip(*r))) for t, r in c.items()} for c in lists]
        self.blocks = [Blocks.of(c, len(self.terms)) for c in self.postings]

    @property
    def words(self) -> list[list[bytes]]:
        return list(map(words_of, self.texts))

    def retrieve(self, length: int, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items of a length class that reach ``threshold`` for the distinct ``terms``: block-max WAND."""
        least = threshold - SLACK
        cursors = [Cursor(p) for t in terms if (p := self.postings[length].get(t))]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c.item)
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c.postings.most
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot].item
            while pivot + 1 < len(cursors) and cursors[pivot + 1].item == item:
                pivot += 1
            upto = cursors[: pivot + 1]
            if sum(c.shallow(item) for c in upto) < least:
                # No item before the end of the shortest of these blocks can reach it.
                ends = [c.postings.last[c.block] + 1 for c in upto if c.block < len(c.postings.last)]
                after = cursors[pivot + 1].item if pivot + 1 < len(cursors) else END
                target = max(min([*ends, after]), item + 1)
                for c in upto:
                    c.seek(target)
            elif cursors[0].item == item:
                score = sum(c.weight for c in upto)
                if score >= least:
                    out.append((item, score))
                for c in upto:
                    c.seek(item + 1)
            else:
                for c in upto:
                    c.seek(item)
            cursors = [c for c in cursors if c.item < END]
        return out

    def overlaps(self, item: int, passage: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and of the answer's words that the passage holds in order and close together, each for itself."""
        words, q = words_of(self.texts[item]), self.questions[item]
        return held_share(words[:q], passage), held_share(words[q:], passage)


def held_share(part: list[bytes], passage: list[bytes]) -> float:
    """The best share of ``part`` in order within windows of SPREAD times its length, which overlap so that any run of a quarter more than its length lies in one."""
    if not part:
        return 1.0
    size, step = round(SPREAD * len(part)), max(1, len(part) // 4)
    return max(len(common(part, passage[at : at + size])) for at in range(0, max(1, len(passage) - size + step), step)) / len(part)


def common(a: list[bytes], b: list[bytes]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Bit-parallel: bit i of a row is 0 where the subsequence of ``b`` so far
    with a[:i + 1] is longer than that with a[:i].
    """
    at: dict[bytes, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for y in b:
        if (m := at.get(y)) is not None:
            row = (row + (row & m) | row & ~m) & full
            rows.append(row)
    out, i, j = [], len(a) - 1, len(rows) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


@dataclass(frozen=True)
class Words:
    """Texts' words in a row: which text, where in it, which term (known ones alone), and where in the text that term stood last."""

    owner: np.ndarray
    at: np.ndarray
    term: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, texts: list[list[bytes]], terms: Mapping[bytes, int]) -> "Words":
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        none = len(terms)
        ids = np.fromiter(map(terms.get, chain.from_iterable(texts), repeat(none)), np.int64, int(sizes.sum()))
        known = np.flatnonzero(ids < none)
        owner = np.repeat(np.arange(len(texts)), sizes)[known]
        at = known - (np.cumsum(sizes) - sizes)[owner]
        term = ids[known]
        order = np.argsort(owner * none + term, kind="stable")
        same = (np.diff(owner[order]) == 0) & (np.diff(term[order]) == 0)
        before = np.full(len(known), -1)
        before[order[1:][same]] = at[order[:-1][same]]
        return cls(owner, at, term, before)


def _likely(index: Index, length: int, sizes: np.ndarray, words: Words, least: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, start, stop, distinct terms) of the passages in which some block of the class may hold an item that reaches ``least``.

    Passages are four times the class's longest item and overlap by half, so
    that any run of twice an item's length lies in one.
    """
    of, step = index.blocks[length], 2 * index.longest[length]
    weight = of.most[words.term]
    listed = np.flatnonzero(weight)
    if not len(listed):
        return
    count = np.maximum(1, -(-sizes // step) - 1)
    first = np.cumsum(count) - count
    owner, at, before = words.owner[listed], words.at[listed], words.before[listed]
    k = at // step
    # Each word is in the passage that begins at its step and in the one before; a term counts where it stands first.
    passages, members = [], []
    for back in (0, 1):
        n = k - back
        ok = (n >= 0) & (n < count[owner]) & (before < n * step)
        passages.append((first[owner] + n)[ok])
        members.append(listed[ok])
    passage, member = np.concatenate(passages), np.concatenate(members)
    total = int(count.sum())
    bound = np.bincount(passage, weight[member], total)
    good = bound[passage] >= least
    passage, member = passage[good], member[good]
    order = np.argsort(passage, kind="stable")
    passage, terms = passage[order], words.term[member[order]]
    cuts = np.flatnonzero(np.diff(passage, prepend=-1))
    ends = np.append(cuts[1:], len(passage))
    lists = of.starts[terms + 1] - of.starts[terms]
    upto = np.concatenate([[0], np.cumsum(lists)])
    a = 0
    while a < len(cuts):
        # As many passages at a time as give some PART_SIZE postings and sums.
        b = int(np.searchsorted(upto[ends], upto[cuts[a]] + PART_SIZE, "right"))
        b = max(a + 1, min(b, a + max(1, PART_SIZE // of.n)))
        lo, hi = cuts[a], ends[b - 1]
        n = lists[lo:hi]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        posting = np.repeat(of.starts[terms[lo:hi]], n) + offset
        row = np.repeat(np.repeat(np.arange(b - a), ends[a:b] - cuts[a:b]), n)
        highest = np.bincount(row * of.n + of.blocks[posting], of.maxima[posting], (b - a) * of.n).reshape(b - a, of.n).max(axis=1)
        for g in (a + np.flatnonzero(highest >= least)).tolist():
            p = int(passage[cuts[g]])
            text = int(np.searchsorted(first, p, "right")) - 1
            start = (p - int(first[text])) * step
            yield text, start, min(start + 2 * step, int(sizes[text])), np.sort(terms[cuts[g] : ends[g]])
        a = b


def leaks_of(index: Index, texts: Iterable[bytes | None], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[dict[int, tuple[float, float, float]]]:
    """For each text: item -> its best (score, question overlap, answer overlap) among the text's passages."""
    waiting: list[list[bytes]] = []
    size = 0
    for text in texts:
        waiting.append(words_of(text) if index.ids and text else [])
        size += len(waiting[-1])
        if size >= PART_SIZE:
            yield from _leaks(index, waiting, threshold, overlap)
            waiting, size = [], 0
    yield from _leaks(index, waiting, threshold, overlap)


def _leaks(index: Index, texts: list[list[bytes]], threshold: float, overlap: float) -> list[dict[int, tuple[float, float, float]]]:
    out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.any():
        return out
    words = Words.of(texts, index.terms)
    for length in range(len(index.longest)):
        for text, start, stop, terms in _likely(index, length, sizes, words, threshold - SLACK):
            for item, score in index.retrieve(length, terms.tolist(), threshold):
                q, a = index.overlaps(item, texts[text][start:stop])
                part = index.questions[item] / index.lengths[item]
                enough = min(q, a) >= EACH * overlap - SLACK and part * q + (1 - part) * a >= overlap - SLACK
                if enough and (score, q, a) > out[text].get(item, (0.0,)):
                    out[text][item] = (score, q, a)
    return out


def leaks(index: Index, text: bytes | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
    """The same for one text."""
    return next(leaks_of(index, [text], threshold, overlap))


def _tokens(rows: DataFrame) -> DataFrame:
    """(words) of every item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words for t in batch.column(0) if (words := words_of(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], ["words"])

    return rows.select("text").mapInArrow(run, "words array<binary>")


def _groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes over groups of items that fit INDEX_BYTES, one after the other, with totals over all items: scores and passages are those of one index."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    groups = max(1, math.ceil(1.5 * total / INDEX_BYTES)) if total > INDEX_BYTES else 1
    distinct = lambda part: _tokens(part).select(F.explode(F.array_distinct("words")).alias("word"))
    if groups > 1:
        lengths = {r.n: r["count"] for r in _tokens(rows).groupBy(F.size("words").alias("n")).count().collect()}
        df = written(distinct(rows).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    for g in range(groups):
        part, of = rows, None
        if groups > 1:
            part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
            own = df.join(distinct(part).distinct(), "word", "left_semi").collect()
            of = totals(lengths, {bytes(r.word): r.df for r in own})
        yield Index(sorted(((r[0], bytes(r[1])) for r in part.collect()), key=lambda x: (x[0] is None, x[0], x[1])), of)


def _hits(rows: DataFrame, index: Index, item_type: str, threshold: float, overlap: float) -> DataFrame:
    names = ["doc_id", "item_id", "bm25_share", "question_overlap", "answer_overlap"]
    broadcast = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = broadcast.value
        for batch in batches:
            found = leaks_of(index, (t.as_py() for t in batch.column(1)), threshold, overlap)
            out = [(doc.as_py(), index.ids[item], *x) for doc, held in zip(batch.column(0), found) for item, x in sorted(held.items())]
            if out:
                columns = [pa.array(list(c)) for c in zip(*out)]
                columns[0] = columns[0].cast(batch.column(0).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, item_id {item_type}, bm25_share double, question_overlap double, answer_overlap double")


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """A row per text and test item it holds: doc_id, item_id, score share and overlaps.

    Nulls: null, empty or wordless texts hold nothing, null or wordless items
    are in nothing; null ids are reported as they are. Equal items are each
    reported; repeated rows each get theirs. Extra columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    item_type = items.schema[item_id_col].dataType.simpleString()
    out = None
    for index in _groups(items, item_id_col, item_text_col):
        hits = _hits(rows, index, item_type, threshold, overlap)
        out = hits if out is None else out.unionByName(hits)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the texts that hold a test item; each text decides for itself, so ids may be null or repeat."""
    for index in _groups(items, "item_id", "text"):
        held = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def clean(texts, held=held):
            return pd.Series([not found for found in leaks_of(held.value, texts, threshold, overlap)], dtype="bool")

        docs = docs.filter(clean(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))
    return docs
