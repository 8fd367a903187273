"""Quality classifier: a small byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes run over the whole text (as sums of looked-up rows,
one table per place of the filter); their outputs are max-pooled over chunks
of two half-chunks, which overlap by one, and pass a ReLU. A document's
features are the mean and the maximum over its chunks, and a logistic unit
makes one probability of them. The filters and the unit are trained
together, by Adam on the cross entropy.

Training takes a bounded sample of labelled rows: those with the smallest hash
of their id, at most ``SAMPLE_ROWS``, and as many of them as have ``SAMPLE_BYTES``
together. It reads their whole texts, in the chunks that scoring takes the mean and
maximum over. Scoring reads every byte of every text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltext.llm import bytetext
from labeltext.llm.staging import stage

WIDTH = 5
FILTERS = 16
HALF = 128
SAMPLE_ROWS = 2400
SAMPLE_BYTES = 16 << 20
SLICE = 1 << 18
#: Half-chunks convolved at once in training.
HALVES_AT_ONCE = 4096


class Model:
    """Filter tables (WIDTH x 256 x FILTERS), filter biases, and the unit."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.unit = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.unit, self.offset]


def convolve(model: Model, data: np.ndarray) -> np.ndarray:
    """Filter outputs (len(data) x FILTERS); bytes behind the end read as 0."""
    padded = np.concatenate((data, np.zeros(WIDTH - 1, np.uint8)))
    out = model.table[0][padded[: len(data)]]
    for j in range(1, WIDTH):
        out += model.table[j][padded[j : j + len(data)]]
    return out


def document_features(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features (texts x 2 FILTERS) of the texts of a slice; empty texts: 0."""
    n = len(offsets) - 1
    out = np.zeros((n, 2 * FILTERS), np.float32)
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    # A filter may look beyond its text's end only at zeros: texts are laid out with gaps.
    gap = np.cumsum(size + WIDTH - 1) - (size + WIDTH - 1)
    laid = np.zeros(int((size + WIDTH - 1).sum()), np.uint8)
    laid[np.arange(len(data)) + np.repeat(gap - offsets[:-1], size)] = data
    conv = convolve(model, laid)
    halves = -(-size[full] // HALF)
    owner = np.repeat(np.arange(len(full)), halves)
    k = np.arange(int(halves.sum())) - np.repeat(np.cumsum(halves) - halves, halves)
    begin = gap[full][owner] + k * HALF
    end = np.minimum(begin + HALF, gap[full][owner] + size[full][owner])
    edges = np.stack((begin, end), axis=1).reshape(-1)
    if edges[-1] == len(conv):
        edges = edges[:-1]
    half = np.maximum.reduceat(conv, edges, axis=0)[::2]  # every second range is a gap
    # A chunk is two neighbouring halves of a text; a text of one half is one chunk.
    chunk = half.copy()
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    chunk[pair] = np.maximum(half[pair], half[pair + 1])
    keep = np.ones(len(half), bool)
    keep[np.cumsum(halves) - 1] = halves == 1
    chunk, owner = np.maximum(chunk[keep] + model.bias, 0), owner[keep]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    count = np.diff(np.r_[first, len(owner)])
    out[full, :FILTERS] = np.add.reduceat(chunk, first, axis=0) / count[:, None]
    out[full, FILTERS:] = np.maximum.reduceat(chunk, first, axis=0)
    return out


def probability(model: Model, features: np.ndarray) -> np.ndarray:
    z = features.astype(np.float64) @ model.unit.astype(np.float64) + float(model.offset[0])
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _pooled(model: Model, x: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(maximum, its place) of every filter over each half-chunk (a row of ``x``: its
    bytes and the WIDTH - 1 after them; ``long`` of them count)."""
    top, place = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
    for lo in range(0, len(x), HALVES_AT_ONCE):
        part = x[lo : lo + HALVES_AT_ONCE]
        conv = model.table[0][part[:, :HALF]]
        for j in range(1, WIDTH):
            conv += model.table[j][part[:, j : j + HALF]]
        conv[np.arange(HALF)[None, :] >= long[lo : lo + HALVES_AT_ONCE, None]] = -np.inf
        at = conv.argmax(axis=1)
        place[lo : lo + len(part)] = at
        top[lo : lo + len(part)] = np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0]
    return top, place


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Model:
    """Fit a model to whole ``texts`` and their ``labels``, 0 or 1. Only the window that wins a
    max-pool gets a gradient. Empty texts are left out; without both labels the model is a constant."""
    model = Model(seed)
    labels = labels[[n for n, t in enumerate(texts) if t]] if len(texts) else labels
    texts = [t for t in texts if t]
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    model.offset[0] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        model.unit[:] = 0
        return model
    weight = np.where(labels == 1, 1.0, np.sqrt(share / (1 - share)))  # the rarer label counts more
    r = np.random.default_rng(seed)
    moment, square, t = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()], 0
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            halves = np.array([-(-len(texts[d]) // HALF) for d in pick])
            x, long = np.zeros((int(halves.sum()), HALF + WIDTH - 1), np.uint8), np.full(int(halves.sum()), HALF)
            row = 0
            for d, n in zip(pick, halves):
                data = np.frombuffer(texts[d].ljust(int(n) * HALF + WIDTH, b"\0"), np.uint8)
                x[row : row + n] = np.lib.stride_tricks.sliding_window_view(data, HALF + WIDTH - 1)[::HALF][:n]
                row += n
                long[row - 1] = len(texts[d]) - (n - 1) * HALF
            half, place = _pooled(model, x, long)
            # A chunk is two neighbouring halves of a text; a text of one half is one chunk.
            last = np.cumsum(halves) - 1
            left = np.setdiff1d(np.arange(len(x)), last[halves > 1])
            doc = np.repeat(np.arange(len(pick)), halves)[left]
            right = np.where(np.isin(left, last), left, left + 1)
            wins = half[left] >= half[right]
            h = np.maximum(np.where(wins, half[left], half[right]) + model.bias, 0)
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            many = np.diff(np.r_[first, len(doc)])
            mean = np.add.reduceat(h, first, axis=0) / many[:, None]
            top = np.maximum.reduceat(h, first, axis=0)
            p = probability(model, np.hstack((mean, top)))
            dz = (weight[pick] * (p - labels[pick]) / len(pick)).astype(np.float32)
            g_unit = np.hstack((mean, top)).T @ dz
            dh = (dz / many)[doc][:, None] * model.unit[None, :FILTERS]
            dh = dh + np.where((h == top[doc]) & (h > 0), dz[doc][:, None] * model.unit[None, FILTERS:], 0)
            dh = np.where(h > 0, dh, 0).astype(np.float32)
            g_half = np.zeros_like(half)
            g_half[left] += np.where(wins, dh, 0)
            g_half[right] += np.where(wins, 0, dh)  # a half is the right one of one chunk at most
            g_table = np.zeros_like(model.table)
            for j in range(WIDTH):
                byte = x[np.arange(len(x))[:, None], place + j]
                np.add.at(g_table[j], (byte, np.arange(FILTERS)[None, :]), g_half)
            t += 1
            for part, g, m, v in zip(model.parts(), [g_table, dh.sum(axis=0), g_unit, np.array([dz.sum()])], moment, square):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                part -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """A model trained on labelled documents outside the held-out fold: at most
    ``rows`` of them, and the first of these by the hash of their id that have
    ``size`` bytes together (one at least), whole. Only those texts come to the driver.
    Null labels, ids and texts are no training rows; if an id is labelled or
    stands in ``docs`` more than once, its smallest label and text are used."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = stage(known, "quality-labels")
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))  # at most ``rows`` rows
    found = stage(found, "quality-sample")
    sizes = found.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    sizes.sort(key=lambda r: (r["h"], r["doc_id"]))
    total = list(itertools.accumulate(r["n"] for r in sizes))
    chosen = [r["doc_id"] for r, n in zip(sizes, total) if n <= size] or [r["doc_id"] for r in sizes[:1]]
    got = {r["doc_id"]: (r["label"], r["text"].encode("utf-8", "surrogatepass")) for r in found.where(F.col("doc_id").isin(chosen)).collect()}
    ids = sorted(got)
    return train([got[i][1] for i in ids], np.array([got[i][0] for i in ids], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Other columns are ignored. A null or empty text has no chunks and gets the
    unit's probability for zero features. Equal texts get equal scores; an empty
    table gives no rows; a null doc_id is not held out.
    """
    bytetext.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())  # some 80 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.table, own.bias, own.unit, own.offset = shared.value
        for batch in bytetext.released(batches):
            data, offsets = bytetext.buffers(batch.column("text"))
            scores = [probability(own, document_features(own, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in bytetext.slices(offsets, SLICE)]
            value = np.round(np.concatenate(scores) if scores else np.zeros(0), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
