"""Quality scores: random Fourier features of document statistics, ridge fit, isotonic calibration.

Each text gives some twenty statistics (lengths, character classes, repetition), found in
one numpy pass. Random cosines of the standardised statistics approximate a Gaussian
kernel; every partition adds up its share of the normal equations, so the ridge fit uses
all labelled rows and the driver only solves a FEATURES-sized system. Raw scores of a
calibration part of the labelled rows are counted in BINS bins, and pooling adjacent
violators over the bins makes them probabilities. All that reaches the driver has a size
that the parameters fix.

Defined results: a null or empty text scores by its (zero) statistics; rows that repeat
are each scored; a doc_id with several labels counts by its smallest; with labels of
less than two kinds every score is the labels' mean, or 0.5; equal texts score equally;
texts of any length pass in bounded chunks; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm import textops as T
from panelspan.llm.common import broadcast_value, cut, ship
from panelspan.llm.numeric import combined

FEATURES, BINS, RIDGE, SEED = 256, 512, 1.0, 5
#: Labels that are broadcast to the texts (about 60 MB); more are joined with the texts' statistics.
LABELS = 1_000_000
#: Kernel width against the root of the number of statistics.
WIDTH = 1.0

_MARKS = "!#*$%&|<>.,?-_=/\\@:;()[]{}\"'"
_CLASSES = {
    "upper": [*range(0x41, 0x5B)],
    "lower": [*range(0x61, 0x7B)],
    "digit": [*range(0x30, 0x3A)],
    "blank": [0x20, *range(0x09, 0x0E)],
    "newline": [0x0A],
    "other": [*range(0x80, 0xC0)],
    "mark": [ord(c) for c in _MARKS],
    "stop": [ord(c) for c in ".,?"],
    "shout": [ord("!")],
    "symbol": [ord(c) for c in "#*$%&<>"],
    "bar": [ord("|")],
    "dash": [ord(c) for c in "-_=/\\@:"],
}
_TABLE = np.zeros((len(_CLASSES), 256), np.uint8)
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLE[_i][_bytes] = 1
STATISTICS = len(_CLASSES) + 13


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _repeated(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each document, how many of its hashes equal an earlier one."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[same], minlength=n).astype(float)


_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS numbers for each document."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = [_sums(_TABLE[i][buf], offsets) / np.maximum(1, size) for i in range(len(_CLASSES))]
    w = T.words(buf, offsets)
    doc, count = w.of_word(), np.diff(w.first).astype(float)
    some = np.maximum(1, count)
    length = (w.end - w.start).astype(float)
    mean = _sums(length, w.first) / some
    caps = np.concatenate([[0], np.cumsum(_TABLE[0][buf], dtype=np.int64)])
    last = buf[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    g = T.grams(w.hash, 3)
    inside = np.flatnonzero(doc[: len(g)] == doc[2:]) if len(g) else np.zeros(0, np.int64)
    lines = T.words(buf, offsets, _NEWLINE)
    n_lines, of_line = np.diff(lines.first).astype(float), lines.of_word()
    out += [
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(0, _sums(length**2, w.first) / some - mean**2)),
        np.log1p(n_lines), np.log1p(size / np.maximum(1, n_lines)),
        _repeated(lines.hash, of_line, n) / np.maximum(1, n_lines),
        _repeated(w.hash, doc, n) / some, _repeated(g[inside], doc[inside], n) / some,
        _sums((caps[w.end] - caps[w.start] >= 2), w.first) / some,
        _sums((last == 0x21), w.first) / some, _sums(_TABLE[9][last], w.first) / some,
        np.minimum(count, 50) / 50,
    ]
    return np.stack(out, 1)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        buf, offsets = T.string_buffer(batch.column("text"))
        rows = [statistics(b, o) for _, _, b, o in T.chunks(buf, offsets)]
        yield batch, np.concatenate(rows) if rows else np.zeros((0, STATISTICS))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, x in _each(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(batch.num_rows, STATISTICS)


class Cosines:
    """Random Fourier features of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, n: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.wave = rng.standard_normal((len(mean), n)) / (WIDTH * np.sqrt(len(mean)))
        self.phase = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        cos = np.cos(z @ self.wave + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([cos, z / 8, np.ones((len(x), 1))], 1)


def _add_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, STATISTICS))
    n = 0
    for batch in batches:
        x = _matrix(batch)
        total += [x.sum(0), (x**2).sum(0)]
        n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])


def _add_normal(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    cosines = shared.value
    total = 0.0
    for batch in batches:
        z = cosines(_matrix(batch))
        both = np.concatenate([z, batch.column("y").to_numpy().astype(float)[:, None]], 1)
        total = total + z.T @ both
    if isinstance(total, np.ndarray):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])


def _add_bins(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    cosines, beta, low, high = shared.value
    total = np.zeros((2, BINS))
    for batch in batches:
        at = _bin(cosines(_matrix(batch)) @ beta, low, high)
        y = batch.column("y").to_numpy().astype(float)
        total += [np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)]
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])


def _bin(raw: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip((raw - low) / (high - low) * BINS, 0, BINS - 1).astype(int)


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators: the nondecreasing means closest to those of the bins; empty bins take what lies below, or above."""
    blocks: list[list[float]] = []
    for c, t in zip(count, total, strict=True):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    mean = np.repeat([t / c if c else np.nan for t, c, _ in blocks], [int(k) for _, _, k in blocks])
    known = np.flatnonzero(~np.isnan(mean))
    return np.full(len(count), 0.5) if not len(known) else mean[known[np.clip(np.searchsorted(known, np.arange(len(count)), "right") - 1, 0, None)]]


def quality_model(docs: DataFrame, labels: DataFrame, calibration=None, most_broadcast: int = LABELS):
    """Fit on docs (doc_id, text) and labels (doc_id, quality): a broadcast (cosines, weights, range, calibrated bins).

    calibration: a condition on doc_id for rows that calibrate instead of being fitted.
    All labelled rows are used, whichever side of the join is sent to the other.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    fold = (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0) if calibration is None else calibration
    known, texts = cut(known, "quality-labels"), docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    if known.count() <= most_broadcast:
        made = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text").mapInArrow(_kept, f"doc_id {kind}, x binary").join(F.broadcast(known), "doc_id")
    else:
        # statistics first, then the join with labels: 200 bytes a document are shuffled, not its text
        made = texts.mapInArrow(_kept, f"doc_id {kind}, x binary").join(known, "doc_id")
    rows = cut(made.select("y", fold.alias("fold"), "x"), "quality-statistics")
    fit, rest = rows.filter("NOT fold"), rows.filter("fold")
    moments = combined(fit.mapInArrow(_add_moments, "n long, total binary").select("total", "n"))
    n = fit.count()
    total = moments.reshape(2, STATISTICS) if moments is not None else np.zeros((2, STATISTICS))
    mean = total[0] / max(1, n)
    spread = np.sqrt(np.maximum(total[1] / max(1, n) - mean**2, 0)) + 1e-6
    cosines = Cosines(mean, spread)
    width = FEATURES + STATISTICS + 1
    shared = broadcast_value(spark, cosines)
    normal = combined(fit.mapInArrow(lambda it: _add_normal(it, shared), "total binary"))
    normal = normal.reshape(width, width + 1) if normal is not None else np.zeros((width, width + 1))
    ridge = RIDGE * np.eye(width)
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(normal[:, :-1] + ridge, normal[:, -1]) if n else np.zeros(width)
    shared = broadcast_value(spark, (cosines, beta, -0.5, 1.5))
    bins = combined(rest.mapInArrow(lambda it: _add_bins(it, shared), "total binary"))
    bins = bins.reshape(2, BINS) if bins is not None else np.zeros((2, BINS))
    level = isotonic(bins[0], bins[1])
    return broadcast_value(spark, (cosines, beta, -0.5, 1.5, level))


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    cosines, beta, low, high, level = shared.value
    for batch, x in _each(batches):
        score = level[_bin(cosines(x) @ beta, low, high)]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, "score"])


def quality(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score (0 to 1) of every row of docs."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(lambda it: _score(it, model), f"{schema}, score double")
