"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positives; any other text is unlabelled, a mixture whose
toxic share is the class prior. The risk estimator subtracts the prior's share of the
positives from the unlabelled loss and, where that part turns negative, climbs back out
instead of descending further. The model is linear over hashed words and word prefixes,
counted per document against the root of its word count, fitted in numpy; the slots it
looks at are those whose share of positives stands out from that of all texts, counted
over every positive and every document, and added up by partition.

The numpy fit takes a bounded sample of labelled rows: about POSITIVES of those called
toxic and UNLABELLED of all of them, whose label is then not looked at, drawn by key hash
at rates that follow from the counts. The prior is the labelled rows' toxic share, which
is also that of the rows taken as unlabelled. Every text is then scored whole.

Defined results: a null or empty text has no features and scores by the intercept; rows
that repeat are each scored; a doc_id that several label rows call toxic is one
positive; slots that stand out equally are taken by number; without labels the prior is
DEFAULT_PRIOR and nothing is learnt; texts of any length pass in bounded chunks; columns
of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm import textops as T
from panelspan.llm.common import broadcast_value, cut, ship, unused
from panelspan.llm.numeric import combined

POSITIVES, UNLABELLED = 3000, 6000
#: Ids of toxic documents that are broadcast (about 40 MB).
LABELS = 1_000_000
PREFIXES = (4, 5, 6, 7, 9)
BITS = 18
#: Slots that the model looks at.
FEATURES = 600
DEFAULT_PRIOR = 0.1


def features(w: T.Words, buf: np.ndarray) -> tuple[np.ndarray, int]:
    """Slots of every word and of its longer prefixes, as one row per word; slot 0 means none."""
    ends = [w.end, *(np.minimum(w.end, w.start + n) for n in PREFIXES)]
    hashes = T.spans_hashes(buf, w.start, ends)
    slots = np.empty((len(w.start), len(ends)), np.uint32)
    for c, (h, e) in enumerate(zip(hashes, ends, strict=True)):
        slot = (h >> T.U64(64 - BITS)).astype(np.uint32) ^ np.uint32(c * 0x15D3)
        slots[:, c] = slot if c == 0 else np.where(e < w.end, slot, 0)
    return slots, len(ends)


def _word_slots(batch: pa.RecordBatch) -> Iterator[tuple[int, int, T.Words, np.ndarray]]:
    """(first row, last + 1, words, slots of each word) of a batch's texts, some at a time."""
    buf, offsets = T.string_buffer(batch.column("text"))
    for i, j, b, o in T.chunks(buf, offsets):
        low = T.LOWER[b]
        start, end = T.word_spans(low, o, T.NON_ALNUM)
        w = T.Words(start, end, np.zeros(0, T.U64), np.searchsorted(start, o))
        yield i, j, w, features(w, low)[0]


def _values(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.log1p(20 * counts / np.sqrt(np.maximum(1, n_words))[:, None])


def _score(batches: Iterator[pa.RecordBatch], shared, keep_text: bool, name: str) -> Iterator[pa.RecordBatch]:
    column, weights, bias = shared.value
    for batch in batches:
        score = np.empty(batch.num_rows)
        for i, j, w, slots in _word_slots(batch):
            col = column[slots]
            at, _ = np.nonzero(col)
            cell = w.of_word()[at] * len(weights) + col[col > 0] - 1
            # few words are features; the cells that occur are far fewer than documents times features
            cells, counts = np.unique(cell, return_counts=True)
            doc, f = cells // max(1, len(weights)), cells % max(1, len(weights))
            size = np.diff(w.first)
            each = np.log1p(20 * counts / np.sqrt(np.maximum(1, size))[doc]) * weights[f]
            score[i:j] = np.bincount(doc, each, j - i) + bias
        names = [c for c in batch.schema.names if c != "text" or keep_text]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(1 / (1 + np.exp(-np.clip(score, -40, 40))))], names=[*names, name])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: how many documents, and how many positives, hold each slot; the last two places count them all."""
    there = np.zeros((2, (1 << BITS) + 1))
    for batch in batches:
        positive = batch.column("positive").to_numpy(zero_copy_only=False)
        for i, j, w, slots in _word_slots(batch):
            for d in range(j - i):
                own = np.unique(slots[w.first[d] : w.first[d + 1]])
                there[0, own] += 1
                if positive[i + d]:
                    there[1, own] += 1
        there[0, -1] += batch.num_rows
        there[1, -1] += positive.sum()
    yield pa.RecordBatch.from_arrays([pa.array([there.tobytes()], pa.binary())], names=["total"])


def choose_slots(there: np.ndarray, n_unl: int, n_pos: int, most: int = FEATURES, least_z: float = 4.0) -> np.ndarray:
    """Slots whose share of positives stands out most from their share of unlabelled texts."""
    pos, unl = there[1] / max(1, n_pos), (there[0] + 0.5) / (n_unl + 1)
    z = (pos - unl) / np.sqrt(unl * (1 - unl) * (1 / max(1, n_pos) + 1 / max(1, n_unl)) + 1e-12)
    z[0] = 0
    z[there[1] < 3] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return best[z[best] > least_z]


def _rows(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The chosen slots' values of each document, as float32 bytes."""
    column = np.zeros(1 << BITS, np.int32)
    column[chosen] = np.arange(1, len(chosen) + 1)
    for batch in batches:
        for i, j, w, slots in _word_slots(batch):
            counts = np.zeros((j - i, len(chosen) + 1))
            np.add.at(counts, (np.repeat(w.of_word(), slots.shape[1]), column[slots].ravel()), 1)
            x = _values(counts[:, 1:], np.diff(w.first)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("positive").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["positive", "x"])


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the non-negative PU risk with the logistic loss, by Adam over the whole sample."""
    theta = np.zeros(x.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    if not positive.any() or positive.all() or not x.shape[1]:
        return theta[:-1], float(theta[-1])
    x = x.astype(np.float32)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n_pos, n_unl = positive.sum(), (~positive).sum()
    for t in range(1, steps + 1):
        g = x @ theta[:-1].astype(np.float32) + theta[-1]
        sig = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        loss_neg = np.logaddexp(0, g)
        rest = loss_neg[~positive].mean() - prior * loss_neg[positive].mean()
        # d/dg of: prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])
        d = np.where(positive, -prior * sig / n_pos, sig / n_unl)
        d = d + np.where(positive, -prior * (1 - sig) / n_pos, 0) if rest >= 0 else -d
        grad = np.append(x.T @ d.astype(np.float32) + ridge * theta[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def toxicity_model(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most_broadcast: int = LABELS):
    """Fit on docs (doc_id, text) and labels (doc_id, toxic): a broadcast (columns, weights, bias)."""
    ship(docs.sparkSession)
    known = cut(labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") == 1).alias("toxic")), "toxic-labels")
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    prior = min(0.9, max(1e-4, n_toxic / n_known)) if n_toxic else DEFAULT_PRIOR
    drawn = lambda salt, most, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) < min(1_000_000, int(1e6 * most / max(1, n)))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    toxic = known.filter("toxic").select("id", F.lit(True).alias("is"))
    # the count was looked at: few enough ids go to the texts, else the planner decides
    marked = text.join(F.broadcast(toxic) if n_toxic <= most_broadcast else toxic, "id", "left").select("text", F.coalesce("is", F.lit(False)).alias("positive"))
    total = combined(marked.mapInArrow(_frequencies, "total binary"), 4) if n_toxic else None
    there = np.zeros((2, (1 << BITS) + 1)) if total is None else total.reshape(2, -1)
    chosen = choose_slots(there[:, :-1], int(there[0, -1]), int(there[1, -1]))
    sample = known.filter("toxic").filter(drawn(11, positives, n_toxic)).select("id", F.lit(True).alias("positive"))
    sample = sample.union(known.filter(drawn(12, unlabelled, n_known)).select("id", F.lit(False)))
    # broadcast: about positives + unlabelled ids, by the rates above
    got = text.join(F.broadcast(sample), "id").select("text", "positive").mapInArrow(lambda it: _rows(it, chosen), "positive boolean, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(got.num_rows, len(chosen))
    order = np.lexsort(x.T[::-1]) if x.size else np.arange(len(x))  # rows come in any order; sums should not depend on it
    weights, bias = fit_nnpu(x[order], got.column("positive").to_numpy().astype(bool)[order], prior)
    column = np.zeros(1 << BITS, np.int32)
    column[chosen] = np.arange(1, len(chosen) + 1)
    return broadcast_value(docs.sparkSession, (column, weights, bias))


def toxicity(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the score (0 to 1), under the name given, of every row of docs."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    return rows.mapInArrow(lambda it: _score(it, model, "text" in keep, name), f"{schema}, `{name}` double")


def acceptable(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs without those that score limit or more under a model of docs and labels; columns unchanged."""
    model = toxicity_model(docs, labels)
    score = unused(docs.columns, "__toxic")
    return toxicity(docs, model, tuple(docs.columns), score).filter(F.col(score) < limit).drop(score)
