"""Toxic passages by maximum-scoring segments.

Token scores are log-odds ratios between toxic and clean labelled texts under
an informative Dirichlet prior. A linear scan finds every maximal segment of a
text (Ruzzo and Tompa, 1999). Extreme-value statistics (Karlin and Altschul,
1990) say which segments are significant for the text's length, and a logistic
fit turns their sum into the probability of the label.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, held_out, sampled

#: Bounds of the sample that the model is fitted on: labelled texts of each
#: class, by hashed id, of at most so many bytes. The driver holds 48 MB of it.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 4000, 8000, 4000

#: Lengths of the word beginnings, in code points, that back off for whole words.
STEMS = (6, 5, 4)

#: Texts that the prior is worth in each class, and what keeps odds finite where
#: every text has the feature.
PRIOR, LEAST = 100.0, 0.5

#: Standard errors by which a score is drawn towards 0, scores' bound, and what every
#: token pays so that a clean text's expected score is negative.
CAUTION, MOST, DRIFT = 1.5, 6.0, 0.25

#: Tokens whose scores a worker remembers.
MEMO = 500_000

#: Segments of the calibration are scored by a model that hasn't seen them.
FOLDS = 4

#: ASCII that parts tokens, all but letters, digits and the apostrophe, becomes a space.
PARTS = bytes(c if c > 127 or c == 39 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[str]:
    """Lower-case tokens. Bytes are translated, which is many times faster than characters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(PARTS).decode("utf-8", "surrogatepass").split()


def features(token: str) -> list[str]:
    """The token, then its beginnings, the longest first; a beginning ends with a space."""
    return [token, *(token[:n] + " " for n in STEMS if len(token) > n)]


def log_odds(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """The signed score of every feature that tells the classes apart.

    Log-odds ratios under an informative Dirichlet prior (Monroe, Colaresi and
    Quinn, 2008): feature counts are of texts, and the prior is PRIOR texts of
    each class with features as frequent as in all texts, so that a feature
    equally frequent in both has a ratio of 0 however rare it is. The ratio is
    drawn towards 0 by CAUTION standard errors; those that reach it are left
    out and score 0.
    """
    out, total = {}, n_toxic + n_clean
    for name in toxic.keys() | clean.keys():
        y1, y0 = toxic.get(name, 0), clean.get(name, 0)
        prior = PRIOR * (y1 + y0) / total
        a, b = y1 + prior, y0 + prior
        odds = math.log(a / (n_toxic + PRIOR - a + LEAST)) - math.log(b / (n_clean + PRIOR - b + LEAST))
        score = abs(odds) - CAUTION * math.sqrt(1 / a + 1 / b)
        if score > 0:
            out[name] = math.copysign(min(score, MOST), odds)
    return out


def score_of(token: str, scores: dict[str, float]) -> float:
    """The strongest score among the token's features, whichever its sign, less the drift; the longest of ties."""
    out = scores.get(token, 0.0)
    for n in STEMS:
        if len(token) > n and abs(score := scores.get(token[:n] + " ", 0.0)) > abs(out):
            out = score
    return out - DRIFT


class Values(dict):
    """token -> score, worked out when first asked for; emptied when it has grown past MEMO."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, token: str) -> float:
        out = self[token] = score_of(token, self.scores)
        return out

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > MEMO:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, stop) with their scores, in linear time.

    Runs of the same sign count as one item each, which changes no segment.
    """
    n = len(scores)
    positive = scores > 0
    if not positive.any():
        return []
    cuts = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate([[0], cuts])
    stops = np.concatenate([cuts, [n]])
    sums = np.add.reduceat(scores, starts)
    before = 0.0
    found: list[tuple[float, float, int, int]] = []  # total left of it, total at its end, start, stop
    # lower[k]: the nearest earlier segment whose left total is less, as in the paper's list.
    lower: list[int] = []
    for start, stop, gain in zip(starts.tolist(), stops.tolist(), sums.tolist()):
        if gain <= 0:
            before += gain
            continue
        left, right, begin = before, before + gain, start
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = lower[j]
            if j < 0 or found[j][1] >= right:
                break
            left, begin = found[j][0], found[j][2]
            del found[j:], lower[j:]
        found.append((left, right, begin, stop))
        lower.append(j)
        before += gain
    return [(b, e, r - l) for l, r, b, e in found]


def karlin_lambda(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * value)) = 1, for a negative mean and some positive value."""
    low, high = 1e-6, 1.0
    while (shares * np.exp(high * values)).sum() < 1 and high < 50:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        if (shares * np.exp(mid * values)).sum() < 1:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@dataclass
class Model:
    scores: dict[str, float]
    rate: float  # lambda
    scale: float  # K
    bias: float
    slope: float

    def __post_init__(self):
        self.values = Values(self.scores)

    def __reduce__(self):
        return Model, (self.scores, self.rate, self.scale, self.bias, self.slope)

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Significant segments: [start, stop) in tokens and the excess of their score, in nats, over what the text's length makes likely."""
        if not self.scores or not words:
            return []
        values = self.values.of(words)
        floor = math.log(max(self.scale * len(words), 1e-12))
        return [(a, b, x) for a, b, s in maximal_segments(values) if (x := self.rate * s - floor) > 0]

    def evidence(self, words: list[str]) -> float:
        """log(1 + summed excess) of the significant segments."""
        return math.log1p(sum(x for _, _, x in self.passages(words)))

    def probability(self, text: str | None) -> float:
        z = self.bias + self.slope * self.evidence(tokens(text))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _counted(rows: list[tuple[list[str], int]]) -> tuple[Counter, Counter, int, int]:
    counts, n = (Counter(), Counter()), [0, 0]
    for words, label in rows:
        n[label] += 1
        counts[label].update({f for w in set(words) for f in features(w)})
    return counts[1], counts[0], n[1], n[0]


def _null(clean: list[np.ndarray]) -> tuple[float, float]:
    """lambda and K of clean texts' token scores: the largest segment of n tokens has P(S > x) = 1 - exp(-K n exp(-lambda x))."""
    v, c = np.unique(np.round(np.concatenate([*clean, np.zeros(0)]), 2), return_counts=True)
    if not len(v) or v[-1] <= 0 or (v * c).sum() >= 0:
        return 1.0, 0.05
    rate = karlin_lambda(v, c / c.sum())
    total = sum(len(x) * math.exp(-rate * max((s for _, _, s in maximal_segments(x)), default=0.0)) for x in clean)
    return rate, max(len(clean) / max(total, 1e-9), 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton's method with halved steps, and a slight ridge."""
    design = np.stack([np.ones_like(x), x], 1)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 5e-3 * (w @ w))

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        gradient = design.T @ (y - p) - 1e-2 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step, size, now = np.linalg.solve(hessian, gradient), 1.0, loss(w)
        while loss(w + size * step) > now and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(rows: list[tuple[str, int]]) -> Model:
    """The model of labelled texts; without both labels every text gets the share of toxic ones, smoothed.

    Null statistics and calibration come from texts that the scores in
    question weren't learned from, fold by fold: on texts that made the scores
    the clean ones look cleaner, the toxic ones more toxic than new ones do.
    """
    rows = [(tokens(t), int(y)) for t, y in rows]
    n1 = sum(y for _, y in rows)
    if not n1 or n1 == len(rows):
        return Model({}, 1.0, 1.0, math.log((n1 + 0.5) / (len(rows) - n1 + 0.5)) if rows else -1.0, 0.0)
    held: list[tuple[Model, list[str], int]] = []
    for k in range(FOLDS):
        rest = [r for i, r in enumerate(rows) if i % FOLDS != k]
        if 0 < sum(r[1] for r in rest) < len(rest):
            fold = Model(log_odds(*_counted(rest)), 1.0, 0.05, 0.0, 1.0)
            held += [(fold, words, y) for i, (words, y) in enumerate(rows) if i % FOLDS == k]
    model = Model(log_odds(*_counted(rows)), 1.0, 0.05, 0.0, 1.0)
    if held:
        model.rate, model.scale = _null([fold.values.of(words) for fold, words, y in held if not y and words])
        for fold, _, _ in held:
            fold.rate, fold.scale = model.rate, model.scale
        x = [fold.evidence(words) for fold, words, _ in held]
        model.bias, model.slope = _logistic(np.array(x), np.array([y for _, _, y in held], float))
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Bounded labelled rows of the learning fold, by hashed id. Of several labels of an id the largest holds."""
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max("toxic").alias("__toxic"))
    )
    known = durable(known)
    there = dict(known.groupBy("__toxic").count().collect())
    both = [sampled(known.filter(F.col("__toxic") == y), there.get(y, 0), n, "__id") for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows, hence safe to broadcast.
    chosen = F.broadcast(durable(both[0].unionByName(both[1])))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(
        F.col("__text").isNotNull() & (F.octet_length("__text") <= SAMPLE_BYTES)
    )
    rows = texts.join(chosen, "__id").groupBy("__id").agg(F.first("__toxic"), F.min("__text")).collect()
    return [(r[2], r[1]) for r in sorted(rows, key=lambda r: r[0])]


def probability_of(model: Model):
    """A Column function: the probability of a text column."""

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series([model.probability(t) for t in texts], dtype="float64")

    return probability


def scored(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None
) -> DataFrame:
    """Per row doc_id, held_out, score, predicted, n_passages and passages: every significant one's start and stop in tokens and its excess, the worst first.

    Nulls: null, empty and wordless texts get the score of a text without
    toxic passages; a null id counts as held out. Repeated rows each get their
    row; extra columns are ignored; an empty table gives an empty result.
    """
    model = fit(sample(docs, labels, id_col, text_col)) if model is None else model
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "score", "predicted", "n_passages", "passages"]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("excess", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            out = []
            for text in batch.column(2):
                found = model.passages(tokens(text.as_py()))
                z = model.bias + model.slope * math.log1p(sum(x for _, _, x in found))
                p = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
                worst_first = sorted(found, key=lambda f: (-f[2], f[0]))
                out.append((p, int(p >= 0.5), len(found), [{"start": a, "stop": b, "excess": x} for a, b, x in worst_first]))
            kinds = (pa.float64(), pa.int32(), pa.int64(), spans)
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages long, passages array<struct<start:long,stop:long,excess:double>>"
    )


def without_toxic(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts predicted toxic, by a model learned from ``labelled_docs`` and ``labels``."""
    probability = probability_of(fit(sample(labelled_docs, labels, text_col=text_col)))
    return docs.filter(probability(F.col(text_col)) < 0.5)
