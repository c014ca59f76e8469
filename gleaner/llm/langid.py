"""Language ID with a bidirectional gated recurrent network over bytes.

The network reads bytes in both directions and labels every position; a
document's probabilities are the mean of its positions'. Whole texts are read,
cut into segments that are worked through side by side, each with states of
its own. It is trained here in numpy by backpropagation through time.

Gates use a hard sigmoid, clip(x / 4 + 1 / 2, 0, 1), which costs a fraction of
the exponential one. Arrays hold features in rows and segments in columns, so
that every step works on contiguous memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, hinted

#: Units in each direction, and bytes of a segment.
UNITS, LENGTH = 10, 64

#: Bounds of the learning sample: texts, by hashed id, and bytes of each.
SAMPLE_TEXTS, SAMPLE_BYTES = 6000, 4000

#: Hashes of a large label's texts that a draw is made from, at least about.
LEAST_HASHES = 64

#: Training: updates, segments in each, learning rate, seed.
UPDATES, BATCH, RATE, SEED = 400, 192, 0.02, 7

#: Segments worked through side by side.
COLUMNS = 2048

UNKNOWN = "und"

#: Byte 0 pads the last segment of a text; padded positions count for nothing.
PAD = 0


def segments(data: bytes, length: int = LENGTH) -> np.ndarray:
    """The bytes of a text in rows of ``length``, the last one padded."""
    n = -(-len(data) // length)
    out = np.zeros(n * length, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, length)


@dataclass
class Net:
    """Per direction: input table (gates x bytes) and recurrent weights (gates x units); then the output layer.

    The gates' rows are update, reset, candidate.
    """

    labels: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]


def new_net(labels: list[str], units: int = UNITS, seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return Net(
        labels,
        [normal(3 * units, 256, scale=0.5) for _ in range(2)],
        [normal(3 * units, units, scale=0.5 / units**0.5) for _ in range(2)],
        normal(len(labels), 2 * units, scale=0.1),
        np.zeros((len(labels), 1), np.float32),
    )


def _states(table: np.ndarray, recurrent: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps x units x columns) after each row of ``steps``; what training needs goes to ``keep``."""
    units, columns = recurrent.shape[1], steps.shape[1]
    h = np.zeros((units, columns), np.float32)
    out = np.empty((len(steps), units, columns), np.float32)
    inputs, inner, change = np.empty((3 * units, columns), np.float32), np.empty((3 * units, columns), np.float32), np.empty_like(h)
    for t, codes in enumerate(steps):
        np.take(table, codes, axis=1, out=inputs, mode="clip")
        np.matmul(recurrent, h, out=inner)
        gates, cand = inputs[: 2 * units], inner[2 * units :]
        gates += inner[: 2 * units]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        if keep is not None:
            keep.append((h.copy(), gates.copy(), cand.copy()))
        cand *= gates[units:]
        cand += inputs[2 * units :]
        np.tanh(cand, out=cand)
        if keep is not None:
            keep[-1] += (cand.copy(),)
        # h' = candidate + update * (h - candidate)
        np.subtract(h, cand, out=change)
        change *= gates[:units]
        np.add(cand, change, out=h)
        out[t] = h
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=-2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-2, keepdims=True)
    return z


def positions(net: Net, rows: np.ndarray) -> np.ndarray:
    """Probabilities (steps x labels x rows) of every byte of ``rows`` of segments."""
    steps = np.ascontiguousarray(rows.T)
    ahead = _states(net.tables[0], net.recurrent[0], steps)
    back = _states(net.tables[1], net.recurrent[1], steps[::-1])[::-1]
    units = net.recurrent[0].shape[1]
    z = np.matmul(net.out[:, :units], ahead)
    z += np.matmul(net.out[:, units:], back)
    z += net.bias
    return _softmax(z)


def _gradients(net: Net, rows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over positions that aren't padding, and its gradients."""
    steps = np.ascontiguousarray(rows.T)
    units = net.recurrent[0].shape[1]
    kept: list[list] = [[], []]
    states = [
        _states(net.tables[0], net.recurrent[0], steps, kept[0]),
        _states(net.tables[1], net.recurrent[1], steps[::-1], kept[1])[::-1],
    ]
    both = np.concatenate(states, axis=1)
    p = _softmax(np.matmul(net.out, both) + net.bias)
    real = (steps != PAD).astype(np.float32)
    total = max(1.0, float(real.sum()))
    columns = np.arange(len(target))
    loss = -float((np.log(p[:, target, columns] + 1e-9) * real).sum()) / total
    p[:, target, columns] -= 1
    p *= real[:, None, :] / total
    g_out = np.einsum("tlc,tuc->lu", p, both)
    g_bias = p.sum(axis=(0, 2))[:, None]
    d_both = np.matmul(net.out.T, p)
    g_tables, g_recurrent = [], []
    for way in (0, 1):
        codes = steps if way == 0 else steps[::-1]
        d_states = d_both[:, :units] if way == 0 else d_both[::-1, units:]
        w = net.recurrent[way]
        g_w, g_t = np.zeros_like(w), np.zeros((256, 3 * units), np.float32)
        dh = np.zeros((units, len(target)), np.float32)
        for t in range(len(codes) - 1, -1, -1):
            h, gates, inner, cand = kept[way][t]
            update, reset = gates[:units], gates[units:]
            dh = dh + d_states[t]
            d_update = dh * (h - cand)
            d_pre = dh * (1 - update) * (1 - cand * cand)
            d_gates = np.concatenate([d_update, d_pre * inner]) * ((gates > 0) & (gates < 1)) * 0.25
            d_inner = np.concatenate([d_gates, d_pre * reset])
            g_w += d_inner @ h.T
            np.add.at(g_t, codes[t], np.concatenate([d_gates, d_pre]).T)
            dh = dh * update + w.T @ d_inner
        g_tables.append(np.ascontiguousarray(g_t.T))
        g_recurrent.append(g_w)
    return loss, [*g_tables, *g_recurrent, g_out.astype(np.float32), g_bias.astype(np.float32)]


def train(texts: list[tuple[bytes, str]], updates: int = UPDATES, seed: int = SEED) -> Net:
    """A network of the labels in ``texts``; every label is drawn alike often."""
    labels = sorted({y for _, y in texts})
    net = new_net(labels, seed=seed)
    if len(labels) < 2:
        return net
    pools = []
    for label in labels:
        rows = [segments(t) for t, y in texts if y == label and t]
        pools.append(np.concatenate(rows) if rows else np.zeros((1, LENGTH), np.uint8))
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, updates + 1):
        target = rng.integers(0, len(labels), BATCH)
        rows = np.stack([pools[y][rng.integers(0, len(pools[y]))] for y in target])
        _, grads = _gradients(net, rows, target)
        norm = sum(float((g * g).sum()) for g in grads) ** 0.5
        rate = RATE * min(1.0, 2 * (1 - step / (updates + 1)))
        for p, g, (m, v) in zip(net.parameters(), grads, moments):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def pooled(net: Net, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (texts x labels) over each text's bytes; zeros for empty ones."""
    sums = np.zeros((len(texts), len(net.labels)))
    owner: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if rows:
            block, own = np.concatenate(rows), np.concatenate(owner)
            for at in range(0, len(block), COLUMNS):
                part = block[at : at + COLUMNS]
                p = positions(net, part)
                if (part[:, -1] == PAD).any():
                    p *= (part.T != PAD)[:, None, :]
                np.add.at(sums, own[at : at + COLUMNS], p.sum(axis=0, dtype=np.float32).T)
        rows.clear()
        owner.clear()
        waiting = 0

    for k, text in enumerate(texts):
        cut = segments(text)
        for at in range(0, len(cut), 8 * COLUMNS):
            part = cut[at : at + 8 * COLUMNS]
            rows.append(part)
            owner.append(np.full(len(part), k))
            waiting += len(part)
            if waiting >= 8 * COLUMNS:
                flush()
    flush()
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)


def quotas(sizes: dict[str, int], total: int) -> dict[str, int]:
    """How many texts to draw of each label: alike many, one at least; what small labels leave goes to the others."""
    out: dict[str, int] = {}
    rest = total
    for done, label in enumerate(sorted(sizes, key=lambda y: (sizes[y], y))):
        out[label] = max(1, min(sizes[label], rest // (len(sizes) - done)))
        rest = max(0, rest - out[label])
    return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[bytes, str]]:
    """Bounded labelled texts of the learning fold, by hashed id, of each label its quota; repeated rows count once."""
    text = F.col(text_col).cast("binary")
    usable = F.col(lang_col).isNotNull() & ~held_out(id_col) & (F.octet_length(text) <= SAMPLE_BYTES) & (F.octet_length(text) > 0)
    known = docs.filter(usable).select(
        text.alias("t"), F.col(lang_col).alias("y"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h")
    )
    about = {r.y: r.n for r in known.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not about:
        return []
    # The driver sees hashes of some four times the quota, and draws the least of them.
    share = {y: max(1, about[y] // max(4 * n, LEAST_HASHES)) for y, n in quotas(about, SAMPLE_TEXTS).items()}
    thinned = F.pmod(F.xxhash64(F.lit(7), "h"), F.col("share")) == 0
    hashes: dict[str, list[int]] = {y: [] for y in about}
    for r in _with(known.select("y", "h"), "label string, share long", list(share.items())).filter(thinned).select("y", "h").distinct().collect():
        hashes[r.y].append(r.h)
    drawn = quotas({y: len(h) for y, h in hashes.items() if h}, SAMPLE_TEXTS)
    last = [(y, share[y], sorted(hashes[y])[n - 1]) for y, n in drawn.items()]
    rows = _with(known, "label string, share long, last long", last).filter(thinned & (F.col("h") <= F.col("last")))
    return [(bytes(r.t), r.y) for r in sorted(rows.dropDuplicates(["y", "h"]).select("t", "y", "h").collect(), key=lambda r: (r.h, r.y))]


def _with(rows: DataFrame, schema: str, labels: list[tuple]) -> DataFrame:
    """``rows`` with what ``labels`` has for their ``y``; other rows go."""
    known = rows.sparkSession.createDataFrame(labels, schema)
    return rows.join(hinted(known, len(labels), 64), F.col("y") == F.col("label"))


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Net | None = None
) -> DataFrame:
    """Per row doc_id, held_out, lang_pred and score, the probability of the prediction.

    Nulls: a null text, or one without a letter, is ``und`` with score 0, as
    is every text where no language was learned; a null id counts as held out.
    Ties go to the first label in order. Repeated rows each get their row;
    extra columns are ignored; an empty table gives an empty result.
    """
    net = train(sample(docs, id_col, text_col, lang_col)) if net is None else net
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
        F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary")).alias("text"),
    )
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            texts = batch.column(2)
            if net.labels:
                p = pooled(net, [t.as_py() or b"" for t in texts])
                best = p.argmax(axis=1)
                score = np.clip(p[np.arange(len(p)), best], 0.0, 1.0)
                pred = pa.array([net.labels[k] for k in best], pa.string())
            else:
                score, pred = np.zeros(len(texts)), pa.nulls(len(texts), pa.string())
            known = pc.and_(pc.is_valid(texts), pc.is_valid(pred))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pc.if_else(known, pred, UNKNOWN), pc.if_else(known, pa.array(score, pa.float64()), 0.0)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
