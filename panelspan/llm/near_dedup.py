"""MinHash near-duplicate detection with odd sketches.

One Arrow pass gives each document its distinct word shingles' count and 128-bit
content key, its MinHash bands, and an odd sketch: the MinHash samples folded into
a parity bitmap, so that the population count of the XOR of two sketches estimates
how many samples differ. Documents with equal shingle sets collapse to one
representative before anything is paired. Each band bucket links its members to a
centre (never all pairs), the sketches discard dissimilar candidates, and what is left
is confirmed on the full shingle sets. Of buckets whose members then still lie in
several components, those outside the largest one are compared on full sets with all
members that the sketches leave open, in blocks, so that no link is lost to the choice
of a centre; only links that join components are emitted. A bucket costs its members
times those that remain outside its largest component.

Defined results: a null or empty text has no shingles and links to nothing; equal
rows are one vertex; a doc_id that repeats with different texts is one vertex too; a
null doc_id gets its shingle count, but no component; ties between centres go to the
smaller doc_id; very long texts are read whole, in chunks of whole documents; columns
other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspan.llm import textops as T
from panelspan.llm.common import cut, settled, ship, unused

SHINGLE = 5
BANDS, ROWS = 30, 5
SKETCH_BITS = 1024
#: Candidates whose sketches put the similarity this far below the threshold are discarded;
#: at 150 samples that is over five standard deviations.
SLACK = 0.2
THRESHOLD = (80, 100)
#: Bounds of a block of a bucket's members; a group is two blocks.
BLOCK_ROWS, BLOCK_CHARS = 512, 1_500_000

_SIGNED = "n_shingles long, key_hi long, key_lo long, bands array<long>, sketch array<long>"


def sketch_limit(similarity: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """The XOR population count expected at a similarity: 2(1-s)k samples differ, each flips a bit."""
    differing = 2 * (1 - similarity) * samples
    return int(bits / 2 * (1 - (1 - 2 / bits) ** differing))


def _sign(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20240229)
    k = BANDS * ROWS
    xor = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    mul = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
    salt = T.mix(np.arange(1, k + 1, dtype=T.U64) * T.U64(0x9E3779B97F4A7C15))
    band_salt = T.mix(np.arange(1, BANDS + 1, dtype=T.U64) * T.U64(0xC2B2AE3D27D4EB4F))
    for batch in batches:
        buf, offsets = T.string_buffer(batch.column("text"))
        for i, j, b, o in T.chunks(buf, offsets):
            g, first = T.document_grams(T.words(b, o), shingle)
            size = np.zeros(j - i, np.int64)
            key = np.zeros((j - i, 2), T.U64)
            sig = np.zeros((j - i, k), np.uint32)
            has = np.flatnonzero(np.diff(first) > 0)
            if len(has):
                at = first[has]
                for d in has:
                    g[first[d] : first[d + 1]].sort()
                new = np.ones(len(g), bool)
                new[1:] = g[1:] != g[:-1]
                new[at] = True
                size[has] = np.add.reduceat(new, at, dtype=np.int64)
                for c, s in enumerate((0x1B873593, 0x85EBCA6B)):
                    key[has, c] = np.add.reduceat(np.where(new, T.mix(g ^ T.U64(s)), T.U64(0)), at)
                x = (g >> T.U64(32)).astype(np.uint32)
                for n in range(k):
                    sig[has, n] = np.minimum.reduceat((x ^ xor[n]) * mul[n], at)
            folded = T.mix(sig.astype(T.U64) + salt)
            band = T.mix((folded.reshape(j - i, BANDS, ROWS) * T._COEF[:ROWS]).sum(2, dtype=T.U64) + band_salt)
            spot = (folded >> T.U64(20)) % T.U64(SKETCH_BITS) + (np.arange(j - i, dtype=T.U64) * T.U64(SKETCH_BITS))[:, None]
            odd = (np.bincount(spot.ravel().astype(np.int64), minlength=(j - i) * SKETCH_BITS) & 1).astype(np.uint8)
            sketch = np.packbits(odd).view(np.int64)
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * n), pa.array(v))
                for v, n in ((band.ravel().view(np.int64), BANDS), (sketch, SKETCH_BITS // 64))
            ]
            rest = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [rest.column("doc_id"), rest.column("text_key"), pa.array(size), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), *lists],
                names=["doc_id", "text_key", "n_shingles", "key_hi", "key_lo", "bands", "sketch"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, n_shingles, key_hi, key_lo, bands, sketch) of every row."""
    return _keyed(docs).mapInArrow(lambda it: _sign(it, shingle), f"doc_id long, text_key long, {_SIGNED}")


def _confirm(batches: Iterator[pa.RecordBatch], shingle: int, least: int, of: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        last, sets = None, {}
        ids = [batch.column(c).to_numpy() for c in ("a", "b")]
        bufs = [T.string_buffer(batch.column(c)) for c in ("a_text", "b_text")]
        for r in range(batch.num_rows):
            both = []
            for c in (0, 1):
                if c == 0 and last == ids[0][r]:
                    both.append(sets)
                    continue
                buf, off = bufs[c]
                text = buf[off[r] : off[r + 1]]
                both.append(np.unique(T.document_grams(T.words(text, np.array([0, len(text)])), shingle)[0]))
            last, sets = ids[0][r], both[0]
            inter = len(np.intersect1d(both[0], both[1], assume_unique=True))
            union = len(both[0]) + len(both[1]) - inter
            keep[r] = union > 0 and of * inter >= least * union
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def texts_of(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of some representatives, written once."""
    need = ids.join(reps.select("doc_id", "text_key"), "doc_id")
    return cut(_keyed(docs).join(need, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text"), "near-texts")


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """Of the candidate pairs (a, b), those similar enough on their full shingle sets."""
    texts = texts_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), reps, docs)
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(b, "b").join(a, "a").mapInArrow(lambda it: _confirm(it, shingle, *threshold), "a long, b long")


def components(edges: DataFrame, label: str = "near-links") -> DataFrame:
    """(doc_id, component): the smallest vertex reachable from each vertex that has a link.

    Alternates large-star and small-star steps; each step's links are written to the
    shared folder, and only their count and checksum come to the driver.
    """
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = digest(links)
    while seen[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        links = cut(small.filter("u <> v").distinct(), label)
        now = digest(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).union(links.select("v", "v").distinct())


def _distance(a: str, b: str):
    """How many bits two sketches differ in."""
    return sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _link_blocks(batches: Iterator[pa.RecordBatch], shingle: int, least: int, of: int) -> Iterator[pa.RecordBatch]:
    """Groups of consecutive rows (bucket, ask_block, block) to links that join their components."""
    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "ask_block", "block")])
        edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for i, j in zip([0, *edge], [*edge, batch.num_rows], strict=True):
            if j == i:
                continue
            now = tuple(keys[:, i])
            if key is not None and now != key:
                yield _spanning(pa.Table.from_batches(held), shingle, least, of)
                held = []
            key = now
            held.append(batch.slice(i, j - i))
    if held:
        yield _spanning(pa.Table.from_batches(held), shingle, least, of)


def _spanning(rows: pa.Table, shingle: int, least: int, of: int) -> pa.RecordBatch:
    """Confirmed links of asking rows to answering rows of other components, as few as join all that can be joined.

    Intersections come from postings over the answering rows' shingles: one bincount
    gives an asking row's against all of them.
    """
    ids, comp, asks = (rows.column(c).to_numpy() for c in ("doc_id", "component", "asks"))
    buf, offsets = T.string_buffer(rows.column("text"))
    g, first = T.document_grams(T.words(buf, offsets), shingle)
    answering, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    sets = [np.unique(g[first[d] : first[d + 1]]) for d in answering]
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, T.U64)
    order = np.argsort(flat, kind="stable")
    names, start = np.unique(flat[order], return_index=True)
    start = np.append(start, len(flat))
    posts = np.repeat(np.arange(len(answering), dtype=np.int32), size)[order]
    del flat, order, sets
    root = np.unique(comp, return_inverse=True)[1].copy()
    a, b = [], []
    for x in asking if len(names) else []:
        own = np.unique(g[first[x] : first[x + 1]])
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        at = at[names[at] == own]
        inter = np.bincount(np.concatenate([posts[start[t] : start[t + 1]] for t in at]), minlength=len(answering)) if len(at) else np.zeros(len(answering), np.int64)
        linked = (of * inter >= least * (len(own) + size - inter)) & (root[answering] != root[x])
        while linked.any():
            y = answering[int(np.argmax(linked))]
            a.append(min(ids[x], ids[y]))
            b.append(max(ids[x], ids[y]))
            root[root == root[y]] = root[x]
            linked &= root[answering] != root[x]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def block_links(asking: DataFrame, answering: DataFrame, texts: DataFrame, shingle: int, threshold: tuple[int, int], rows: int = BLOCK_ROWS, chars: int = BLOCK_CHARS) -> DataFrame:
    """Links (a, b) that join the components met in each bucket; both sides are (bucket, doc_id, component).

    Every asking member meets every answering one of its bucket. Each side is split into
    blocks of bounded rows and characters, and a block of one with a block of the other
    is one group: a bucket of any size is spread over many tasks, and while its asking
    members fill one block, its answering members are sent once.
    """
    length = texts.select("doc_id", F.length("text").alias("n_chars"))

    def placed(side: DataFrame, block: str) -> tuple[DataFrame, DataFrame]:
        total = side.join(length, "doc_id").groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n_chars") / chars), F.lit(1)).cast("int").alias(f"n_{block}"))
        return side.join(total, "bucket").withColumn(block, F.pmod(F.xxhash64("doc_id"), f"n_{block}").cast("int")), total

    asks, n_asks = placed(asking, "ask_block")
    answers, n_answers = placed(answering, "block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = asks.join(n_answers, "bucket").select("bucket", "doc_id", "component", F.lit(True).alias("asks"), "ask_block", every("n_block").alias("block"))
    answers = answers.join(n_asks, "bucket").select("bucket", "doc_id", "component", F.lit(False).alias("asks"), every("n_ask_block").alias("ask_block"), "block")
    key = ("bucket", "ask_block", "block")
    full = asks.unionByName(answers).join(texts, "doc_id").repartition(*key).sortWithinPartitions(*key, "asks", "doc_id")
    return full.mapInArrow(lambda it: _link_blocks(it, shingle, *threshold), "a long, b long").distinct()


def _mixed(members: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """(bucket, doc_id, component, top, sketch) of the buckets whose members are in several components; top is the one with most."""
    named = members.join(labels, "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy("bucket").agg(F.max_by("component", "n").alias("top"), F.count("*").alias("k")).filter("k > 1").select("bucket", "top")
    return cut(named.join(top, "bucket").join(sketches, "doc_id"), "near-mixed")


def star_links(reps: DataFrame, members: DataFrame, docs: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """Confirmed links of each bucket's centre to its other members.

    The centre is the member whose buckets are fullest, the most typical of a group of copies: it is similar to more
    of them than an arbitrary one, which may itself be far edited.
    """
    degree = members.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    centres = members.join(degree, "doc_id").groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("doc_id").alias("centre")))["centre"].alias("centre"))
    stars = members.join(centres, "bucket").filter("doc_id <> centre").select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b")).distinct()
    sketches, limit = reps.select("doc_id", "sketch"), sketch_limit(threshold[0] / threshold[1] - SLACK)
    right, left = sketches.withColumnRenamed("doc_id", "b").alias("r"), sketches.withColumnRenamed("doc_id", "a").alias("l")
    close = stars.join(right, "b").join(left, "a").filter(_distance("l", "r") <= limit).select("a", "b")
    return confirmed(cut(close, "near-pairs"), reps, docs, shingle, threshold)


def open_links(mixed: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """Every link that still joins components in a bucket: the members outside its top component against all that are close to them."""
    limit = sketch_limit(threshold[0] / threshold[1] - SLACK)
    near = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.component") != F.col("r.component")) & (_distance("l", "r") <= limit)
    asking = cut(mixed.filter("component <> top").alias("l").join(mixed.alias("r"), near, "left_semi").select("bucket", "doc_id", "component", "sketch"), "near-asking")
    answering = cut(mixed.alias("l").join(asking.alias("r"), near, "left_semi").select("bucket", "doc_id", "component"), "near-answering")
    texts = texts_of(asking.select("doc_id").union(answering.select("doc_id")).distinct(), reps, docs)
    return block_links(asking.drop("sketch"), answering, texts, shingle, threshold)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row of docs (doc_id, text); text_key is the text's hash."""
    spark = docs.sparkSession
    ship(spark)
    signed = cut(signatures(docs, shingle), "near-signed")
    groups = signed.filter("n_shingles > 0").groupBy("key_hi", "key_lo", "n_shingles").agg(F.min("doc_id").alias("rep"))
    groups = cut(groups.filter("rep IS NOT NULL"), "near-groups")

    def linked() -> DataFrame:
        # a representative's row: doc_id alone is nearly unique, so this join has no hot key
        chosen = groups.select(F.col("rep").alias("doc_id"), "key_hi", "key_lo", "n_shingles").distinct()
        reps = cut(signed.join(chosen, ["doc_id", "key_hi", "key_lo", "n_shingles"]).dropDuplicates(["doc_id", "key_hi", "key_lo"]).select("doc_id", "text_key", "bands", "sketch"), "near-reps")
        sketches = reps.select("doc_id", "sketch")
        buckets = reps.select("doc_id", F.explode("bands").alias("bucket"))
        shared = buckets.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).filter("least <> most").select("bucket", "n")
        members = cut(buckets.join(shared, "bucket"), "near-buckets")
        links = cut(star_links(reps, members, docs, shingle, threshold), "near-confirmed")
        labels = components(links)
        # what a bucket's centre didn't join may still join each other across components
        mixed = _mixed(members, labels, sketches)
        if mixed.take(1):
            more = cut(open_links(mixed, reps, docs, shingle, threshold), "near-confirmed")
            if more.take(1):
                labels = components(links.union(more))
        return labels

    labels = settled(spark, "near-labels", linked)
    named_groups = groups.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("key_hi", "key_lo", "n_shingles", F.coalesce("component", "rep").alias("component"))
    return (
        signed.select("doc_id", "text_key", "n_shingles", "key_hi", "key_lo")
        .join(named_groups, ["key_hi", "key_lo", "n_shingles"], "left")
        .select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near copies, columns unchanged.

    Of rows with the same doc_id and text the one whose other columns are the least as
    JSON stays; unlike texts under one doc_id are documents of their own, which stay or
    go together; rows with a null doc_id all stay.
    """
    id_, key = unused(docs.columns, "__id"), unused(docs.columns, "__key")
    verdict = near_duplicates(docs, shingle, threshold).filter("doc_id IS NOT NULL").groupBy("doc_id", "text_key").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    away = cut(verdict.filter("NOT kept OR n > 1").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), "kept"), "near-away")
    same = (docs["doc_id"].cast("long") == away[id_]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == away[key])
    rest = docs.join(away, same, "left_anti")
    repeated = away.filter("kept").drop("kept")
    if not repeated.take(1):
        return rest
    again = docs.join(repeated, (docs["doc_id"].cast("long") == repeated[id_]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == repeated[key]))
    row = F.struct(*[docs[c] for c in docs.columns])
    one = again.groupBy(id_, key).agg(F.min_by(row, F.to_json(row)).alias("r"))
    return rest.unionByName(one.select(*[F.col("r").getField(c).alias(c) for c in docs.columns]))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), k AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
