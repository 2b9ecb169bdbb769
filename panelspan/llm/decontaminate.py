"""Benchmark decontamination by winnowing.

Both sides' word k-grams are hashed, and of every w consecutive ones the smallest
(rightmost on ties) is a fingerprint; w + k - 1 is the window, so every shared window
contains a fingerprint that both sides chose. Document fingerprints are joined with
those of the benchmark, and each hit is extended to the windows around it, which are
looked up whole. Items shorter than a window are one window of their own length,
looked up at every position.

The benchmark is split by item into shards of a bounded number of characters, checked
before anything is broadcast; one shard is the usual case and needs no shuffle at all.
With more, each shard in turn is collected, broadcast, searched, its hits stored, and
given up before the next one, so driver and executors hold one; the hits are then merged
by document.

Defined results: a null text has no words; an item without words never occurs; rows
that repeat are each answered; an item_id on several rows is one item; a null item_id
marks words as hit, but is not listed; very long texts are searched whole, in chunks of
whole documents; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm import textops as T
from panelspan.llm.common import broadcast_value, cut, unused

WINDOW, GRAM = 10, 5
#: Benchmark characters in one broadcast index (some 60 MB of hashes).
SHARD_CHARS = 16_000_000
_FILTER_BITS = 22
_FOUND = "doc_id long, text_key long, n_words long, starts array<long>, ends array<long>, items array<string>"


def fingerprints(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the winnowed k-grams of each document."""
    g = T.grams(hashes, k)
    w = window - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, T.U64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        take = g[j : j + n] <= best
        best[take] = g[j : j + n][take]
        at[take] = j
    whole = np.zeros(len(hashes) + 1, np.int64)
    long = np.diff(first) >= window
    whole[first[:-1][long]] += 1
    np.add.at(whole, first[1:][long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(whole)[:n] > 0)
    chosen = np.zeros(len(g), bool)
    chosen[starts + at[starts]] = True
    pos = np.flatnonzero(chosen)
    return pos, g[pos]


@dataclass
class Lookup:
    """Hashes, each with the items that have it."""

    keys: np.ndarray
    first: np.ndarray
    items: np.ndarray
    maybe: np.ndarray = field(init=False)

    def __post_init__(self):
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.keys >> T.U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    @classmethod
    def of(cls, hashes: np.ndarray, items: np.ndarray) -> Lookup:
        pairs = np.unique(np.rec.fromarrays([hashes, items], names="h,i"))
        keys, first = np.unique(pairs.h, return_index=True)
        return cls(keys, np.append(first, len(pairs)), np.asarray(pairs.i))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes into hashes, indexes into keys) of those that are there."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        idx = np.flatnonzero(self.maybe[(hashes >> T.U64(64 - _FILTER_BITS)).astype(np.int64)])
        key = np.searchsorted(self.keys, hashes[idx])
        ok = (key < len(self.keys)) & (self.keys[np.minimum(key, len(self.keys) - 1)] == hashes[idx])
        return idx[ok], key[ok]


@dataclass
class Index:
    """What one shard of the benchmark is searched by."""

    names: list
    marks: Lookup
    windows: Lookup
    short: dict[int, Lookup]


def build_index(ids: list, texts: list, window: int = WINDOW, k: int = GRAM) -> Index:
    names = sorted({i for i in ids if i is not None})
    rank = {n: r for r, n in enumerate(names)}
    item = np.array([rank.get(i, -1) for i in ids], np.int64)
    buf, offsets = T.string_buffer(pa.array(texts, pa.large_string()))
    w = T.words(buf, offsets, T.NON_ALNUM)
    _, mark = fingerprints(w.hash, w.first, window, k)
    g, first = T.document_grams(w, window)
    of_gram = np.repeat(np.arange(len(ids)), np.diff(first))
    size = np.diff(w.first)
    full = size[of_gram] >= window
    short = {int(n): Lookup.of(g[size[of_gram] == n], item[of_gram[size[of_gram] == n]]) for n in np.unique(size[(size > 0) & (size < window)])}
    return Index(names, Lookup.of(mark, np.zeros(len(mark), np.int64)), Lookup.of(g[full], item[of_gram[full]]), short)


def search(w: T.Words, index: Index, window: int = WINDOW, k: int = GRAM) -> list[tuple[np.ndarray, int, Lookup, np.ndarray]]:
    """(word positions, length, lookup, keys) of the benchmark windows that occur."""
    found = []
    size = np.diff(w.first)
    doc_end = np.repeat(w.first[1:], size)
    doc_first = np.repeat(w.first[:-1], size)
    pos, mark = fingerprints(w.hash, w.first, window, k)
    hit, _ = index.marks.find(mark)
    if len(hit):
        at = pos[hit]
        start = np.unique((at[:, None] - np.arange(window - k + 1)).ravel())
        start = start[start >= 0]
        start = start[start + window <= doc_end[start]]
        g = T.grams(w.hash, window)
        idx, key = index.windows.find(g[start])
        found.append((start[idx], window, index.windows, key))
    for n, lookup in index.short.items():
        idx, key = lookup.find(T.grams(w.hash, n))
        ok = idx + n <= doc_end[idx]
        found.append((idx[ok], n, lookup, key[ok]))
    return found


def _search(batches: Iterator[pa.RecordBatch], shared, window: int, k: int, all_rows: bool) -> Iterator[pa.RecordBatch]:
    index: Index = shared.value
    for batch in batches:
        buf, offsets = T.string_buffer(batch.column("text"))
        for i, j, b, o in T.chunks(buf, offsets):
            w = T.words(b, o, T.NON_ALNUM)
            doc = w.of_word()
            cover = np.zeros(len(w.hash) + 1, np.int64)
            pairs = [np.zeros(0, np.int64)]
            for at, n, lookup, key in search(w, index, window, k):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n, -1)
                both = np.unique(doc[at] * len(lookup.keys) + key)
                d, key = both // max(1, len(lookup.keys)), both % max(1, len(lookup.keys))
                many = lookup.first[key + 1] - lookup.first[key]
                spot = np.repeat(lookup.first[key] - np.concatenate([[0], np.cumsum(many)[:-1]])[: len(key)], many) + np.arange(many.sum())
                items = lookup.items[spot]
                pairs.append((np.repeat(d, many) * (len(index.names) + 1) + items)[items >= 0])
            hit = np.cumsum(cover[:-1]) > 0
            edge = np.zeros(len(hit) + 1, bool)
            edge[w.first] = True
            before = np.concatenate([[False], hit[:-1]]) & ~edge[:-1]
            after = np.concatenate([hit[1:], [False]]) & ~edge[1:]
            start, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
            lists = [np.searchsorted(start, w.first).astype(np.int32)]
            of_start = doc[start]
            both = np.unique(np.concatenate(pairs))
            of_item = np.searchsorted(both, np.arange(j - i + 1) * (len(index.names) + 1)).astype(np.int32)
            local = w.first[of_start] if len(of_start) else np.zeros(0, np.int64)
            names = np.array(index.names, dtype=object)[both % (len(index.names) + 1)] if len(both) else []
            rest = batch.slice(i, j - i)
            out = pa.RecordBatch.from_arrays(
                [
                    rest.column("doc_id"), rest.column("text_key"), pa.array(np.diff(w.first)),
                    pa.ListArray.from_arrays(pa.array(lists[0]), pa.array(start - local)),
                    pa.ListArray.from_arrays(pa.array(lists[0]), pa.array(end - local)),
                    pa.ListArray.from_arrays(pa.array(of_item), pa.array(names, pa.string())),
                ],
                names=["doc_id", "text_key", "n_words", "starts", "ends", "items"],
            )
            yield out if all_rows else out.filter(pa.array(np.diff(lists[0]) > 0))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, text_key, n_words, spans array<struct<start, end>> of hit words, items array<string>) of every row of docs.

    spans are disjoint and in order; items are sorted as strings; text_key is the hash of the text.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_shards = max(1, -(-int(chars) // shard_chars))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    parts = []
    for s in range(n_shards):
        # an item stands in one shard, so an item without an id is dealt by its text
        shard = rows if n_shards == 1 else rows.filter(F.pmod(F.xxhash64(F.coalesce("item_id", "text")), F.lit(n_shards)) == s)
        got = shard.collect()
        shared = broadcast_value(spark, build_index([r[0] for r in got], [r[1] for r in got], window, k))
        part = keyed.mapInArrow(lambda it, shared=shared, one=n_shards == 1: _search(it, shared, window, k, one), _FOUND)
        parts.append(part if n_shards == 1 else cut(part, "leaks-of-shard"))
        if n_shards > 1:
            shared.unpersist()
    if n_shards == 1:
        found = parts[0]
    else:
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.union(p)
        merged = merged.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("starts", "ends")).alias("found"), F.flatten(F.collect_set("items")).alias("items"))
        # a shard's starts and ends stay together: as sets of their own, equal starts of two shards would leave ends without one
        merged = merged.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.flatten("found.starts").alias("starts"), F.flatten("found.ends").alias("ends"), "items")
        empty = broadcast_value(spark, build_index([], [], window, k))
        counted = keyed.mapInArrow(lambda it: _search(it, empty, window, k, True), _FOUND).select("doc_id", "text_key", "n_words")
        found = counted.join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
        for c, kind in (("starts", "array<long>"), ("ends", "array<long>"), ("items", "array<string>")):
            found = found.withColumn(c, F.coalesce(c, F.array().cast(kind)))
        found = found.transform(_merge_spans)
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end")))
    return found.select("doc_id", "text_key", "n_words", spans.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def _merge_spans(found: DataFrame) -> DataFrame:
    """Spans of several shards, which may overlap, as disjoint ones: those starts (ends) that no other span reaches over."""
    marks = F.array_sort(F.concat(F.transform("starts", lambda x: F.struct(x.alias("p"), F.lit(-1).alias("s"))), F.transform("ends", lambda x: F.struct(x.alias("p"), F.lit(1).alias("s")))))
    zero = F.struct(F.lit(0).alias("open"), F.array().cast("array<bigint>").alias("starts"), F.array().cast("array<bigint>").alias("ends"))
    step = lambda acc, x: F.struct(
        (acc["open"] - x["s"]).alias("open"),
        F.when((x["s"] == -1) & (acc["open"] == 0), F.concat(acc["starts"], F.array(x["p"]))).otherwise(acc["starts"]).alias("starts"),
        F.when((x["s"] == 1) & (acc["open"] == 1), F.concat(acc["ends"], F.array(x["p"]))).otherwise(acc["ends"]).alias("ends"),
    )
    done = found.withColumn("m", F.aggregate(marks, zero, step))
    return done.withColumn("starts", F.col("m.starts")).withColumn("ends", F.col("m.ends")).drop("m")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of contamination()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window; columns unchanged.

    A row is judged by its doc_id and text together, so neither a null nor a repeated id takes clean rows along.
    """
    id_, key = unused(docs.columns, "__bad"), unused(docs.columns, "__key")
    # stored, so that the planner knows its size and need not shuffle the texts if it is small
    bad = cut(contamination(docs, benchmark).filter(F.size("spans") > 0).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct(), "leaks")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key))
    return docs.join(bad, same, "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), q AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + 9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)
), x AS (
  SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) AS m)
), h AS (
  SELECT rid, i, x.n, item_id FROM x JOIN q ON x.n = q.n AND x.g = q.g
), c AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1
), k AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)
"""
