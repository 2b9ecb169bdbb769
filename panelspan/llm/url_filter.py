"""URL filtering: host and path rules, and for the rest a character language-model ratio.

Rules judge what they fit, the longest first. What rules can name (as many labels at a
host's end and segments at a path's beginning as the deepest rule has) is taken out of
the text that is modelled, of every URL alike whether a rule fits it or not, so the
models learn what the judged URLs are like instead of repeating the rules, or a
top-level domain that rules happen not to name, to all others. URLs that rules allow or block train two
smoothed variable-order Markov models over characters (Witten-Bell weights, longest
context first); the counts cover every such URL but those of the part kept for the
threshold, and are exact: a gram is its own bytes, packed, and Spark adds up and stores
as many as there are. They are broadcast in shards of about SHARD_GRAMS. All grams of a
context are in one shard, so each place of a URL is scored whole by one of them, and
the URLs pass the shards one after the other. A URL without a rule is blocked if its
length-normalised log-likelihood difference, accepted against rejected, is under a
threshold calibrated on the rule-judged URLs of a part kept out of the counts: the
largest one that blocks at most FALSE_BLOCKS of the accepted.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and, having nothing to score, is allowed; without rule-judged URLs of both kinds
all others are allowed; rows that repeat are each judged, and count as often in the
models; a URL of any length is scored whole, in bounded chunks; of other columns only
those that are kept are looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspan.llm import textops as T
from panelspan.llm.common import broadcast_value, cut, ship

#: (rule, verdict): a host, a slash, and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 6
#: Grams in one broadcast shard (some 130 MB at most), unless a single pair of bytes has more.
SHARD_GRAMS = 2_000_000
FALSE_BLOCKS = 0.01
#: Bins of the calibration counts, over differences of -RANGE to RANGE nats a character.
BINS, RANGE = 2000, 10.0
HELD_PARTS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def unnamed(host: Column, path: Column, rest: Column, rules=RULES) -> Column:
    """The part of a URL that rules can't name: its host without as many last labels as the deepest rule's, but for its
    first, and what follows without as many path segments as the deepest rule's."""
    labels = max((len(r.partition("/")[0].split(".")) for r, _ in rules), default=0)
    segments = max((r.partition("/")[2].count("/") for r, _ in rules), default=0)
    left = F.regexp_replace(host, rf"(?<=[^.])(\.[^.]*){{0,{labels}}}$", "") if labels else host
    tail = F.lower(F.substr(rest, F.length(host) + 1))
    return F.concat(left, F.lit("/"), F.regexp_replace(tail, rf"^/([^/?#]*/){{0,{segments}}}", ""))


_BYTES = T.U64((1 << 48) - 1)


def _windows(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each place the bytes of its URL that end there, ORDER at most, packed: how many, above 48 bits of bytes."""
    place = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = np.minimum(place + 1, ORDER).astype(T.U64) << T.U64(48)
    for k in range(ORDER):
        at = np.flatnonzero(place >= k)
        key[at] |= buf[at - k].astype(T.U64) << T.U64(8 * k)
    return key


def _length(key: np.ndarray) -> np.ndarray:
    return (key >> T.U64(48)).astype(np.int64)


def _ending(window: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of windows that have as many."""
    return (window & T.U64((1 << 8 * n) - 1)) | T.U64(n << 48)


def _context(gram: np.ndarray) -> np.ndarray:
    """Grams without their last byte."""
    return ((gram & _BYTES) >> T.U64(8)) | (((gram >> T.U64(48)) - T.U64(1)) << T.U64(48))


def _pair(key: np.ndarray) -> np.ndarray:
    """The two bytes before the last."""
    return ((key >> T.U64(8)) & T.U64(0xFFFF)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, good, bad) of the URLs of each batch."""
    for batch in batches:
        allowed = batch.column("allowed").to_numpy(zero_copy_only=False)
        for kind in (False, True):
            for _, _, buf, offsets in T.chunks(*T.string_buffer(batch.column("text").filter(pa.array(allowed == kind)))):
                window, n = np.unique(_windows(buf, offsets), return_counts=True)
                some = [(k, _length(window) >= k) for k in range(1, ORDER + 1)]
                gram, at = np.unique(np.concatenate([_ending(window[x], k) for k, x in some]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n[x] for _, x in some]), len(gram)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n * kind), pa.array(n * (not kind))], names=["gram", "good", "bad"])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes into keys, which of them fit)."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Markov:
    """Exact counts, of accepted and of rejected URLs, of one shard's grams: those of one or two bytes, and those whose pair is in lo to hi."""

    def __init__(self, grams: pa.Table, lo: int, hi: int):
        key = grams.column("gram").to_numpy().astype(T.U64)
        order = np.argsort(key)
        self.lo, self.hi, self.gram = lo, hi, key[order]
        self.n = [grams.column(c).to_numpy()[order] for c in ("good", "bad")]
        self.context, at = np.unique(_context(self.gram), return_inverse=True)
        self.seen = [np.bincount(at, n, len(self.context)) for n in self.n]
        self.kinds = [np.bincount(at, n > 0, len(self.context)) for n in self.n]

    def has(self, window: np.ndarray) -> np.ndarray:
        """Whether this shard scores a place; those of one or two bytes are the first shard's."""
        pair = np.where(_length(window) > 2, _pair(window), 0)
        return (pair >= self.lo) & (pair <= self.hi)

    def gap(self, window: np.ndarray) -> np.ndarray:
        """Log-likelihood of each window's last byte after those before it, accepted less rejected."""
        p = np.full((2, len(window)), 1 / 256)
        size = _length(window)
        for n in range(ORDER):
            at = np.flatnonzero(size > n)
            gram = _ending(window[at], n + 1)
            context, known = _find(self.context, _context(gram))
            at, gram, context = at[known], gram[known], context[known]
            spot, there = _find(self.gram, gram)
            for k in range(2):
                seen, kinds = self.seen[k][context], self.kinds[k][context]
                mixed = (np.where(there, self.n[k][spot], 0) + kinds * p[k, at]) / np.maximum(1, seen + kinds)
                p[k, at] = np.where(seen > 0, mixed, p[k, at])
        return np.log(p[0]) - np.log(p[1])


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The batches with the difference a character that this shard's places make added to difference."""
    model: Markov = shared.value
    for batch in batches:
        difference = batch.column("difference").to_numpy().copy()
        for i, j, buf, offsets in T.chunks(*T.string_buffer(batch.column("text"))):
            size = np.diff(offsets)
            window = _windows(buf, offsets)
            own = np.flatnonzero(model.has(window))
            kinds, at = np.unique(window[own], return_inverse=True)
            gap = np.bincount(np.repeat(np.arange(j - i), size)[own], model.gap(kinds)[at], j - i)
            difference[i:j] += gap / np.maximum(1, size)
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([pa.array(difference) if c == "difference" else batch.column(c) for c in names], names=names)


def _scored(df: DataFrame, counts: DataFrame, shards: list[tuple[int, int]]) -> DataFrame:
    """df with the difference of its text, shard after shard; one is the usual case and needs nothing stored."""
    df = df.withColumn("difference", F.lit(0.0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    for k, (lo, hi) in enumerate(shards):
        own = counts if len(shards) == 1 else counts.filter((F.col("gram") < 3 << 48) | _pair_of("gram").between(lo, hi))
        shared = broadcast_value(df.sparkSession, Markov(own.toArrow(), lo, hi))
        df = df.mapInArrow(lambda it, shared=shared: _score(it, shared), schema)
        if k < len(shards) - 1:
            df = cut(df, "url-scores")
            shared.unpersist()
    return df


def _pair_of(gram: str) -> Column:
    return F.shiftright(gram, 8).bitwiseAND(F.lit(0xFFFF))


def _shards(counts: DataFrame, shard_grams: int) -> list[tuple[int, int]]:
    """Ranges of pairs, first to last, with about shard_grams grams each."""
    size = np.zeros(1 << 16, np.int64)
    for pair, n in counts.filter(F.col("gram") >= 3 << 48).groupBy(_pair_of("gram").alias("pair")).count().collect():
        size[pair] = n
    first = np.unique((np.cumsum(size) - size) // shard_grams, return_index=True)[1].tolist()
    return list(zip(first, [*(x - 1 for x in first[1:]), len(size) - 1], strict=True))


def url_model(judged: DataFrame, shard_grams: int = SHARD_GRAMS):
    """From (text, allowed, held): (stored counts, shards, threshold), or None without both kinds."""
    counts = judged.filter("NOT held").select("text", "allowed").mapInArrow(_count, "gram long, good long, bad long")
    counts = cut(counts.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-grams")
    if not all(counts.agg(F.sum("good"), F.sum("bad")).first()):
        return None
    shards = _shards(counts, shard_grams)
    scored = _scored(judged.filter("held AND allowed").select("text"), counts, shards)
    at = F.least(F.greatest(F.floor((F.col("difference") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = np.zeros(BINS)
    for b, c in scored.groupBy(at.alias("b")).count().collect():
        bins[b] = c
    below = np.concatenate([[0], np.cumsum(bins)])
    edge = int(np.searchsorted(below, FALSE_BLOCKS * bins.sum(), "right")) - 1
    return counts, shards, min(0.0, edge / BINS * 2 * RANGE - RANGE)


def judge(pages: DataFrame, rules=RULES, keep: tuple[str, ...] = ("page_id",), shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """The kept columns with host, path, rule, verdict and difference (null where a rule decides) of every row."""
    ship(pages.sparkSession)
    verdicts = dict(rules)
    # distinct helper names: pages may have columns of its own called host, path or rule
    base = pages.select(*keep, host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path"), F.coalesce(_rest(F.col("url")), F.lit("")).alias("__rest"))
    base = base.withColumn("__text", F.when(F.col("__rest") == "", F.lit("")).otherwise(unnamed(F.col("__host"), F.col("__path"), F.col("__rest"), rules))).drop("__rest")
    base = base.withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules))
    allowed = F.col("__rule").isin([r for r, v in verdicts.items() if v == "allow"])
    held = F.pmod(F.crc32(F.col("__text").cast("binary")), F.lit(HELD_PARTS)) == 0
    model = url_model(base.filter("__rule IS NOT NULL").select(F.col("__text").alias("text"), allowed.alias("allowed"), held.alias("held")), shard_grams)
    names = [F.col(c) for c in keep]
    parts = [F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule")]
    by_rule = F.when(allowed, F.lit("allow")).otherwise(F.lit("block"))
    if model is None:
        return base.select(*names, *parts, F.when(F.col("__rule").isNotNull(), by_rule).otherwise(F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("difference"))
    counts, shards, threshold = model
    scored = _scored(base.withColumnRenamed("__text", "text"), counts, shards)
    verdict = F.when(F.col("__rule").isNotNull(), by_rule).when(F.col("difference") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*names, *parts, verdict.alias("verdict"), F.when(F.col("__rule").isNull(), F.col("difference")).alias("difference"))
