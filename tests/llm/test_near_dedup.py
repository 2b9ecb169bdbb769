"""Near-duplicates against all pairs, on small texts and on a family of edited copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspan.llm import near_dedup as N
from panelspan.llm import textops as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(docs, k):
    sets = {}
    for d, t in docs:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in docs], SCHEMA)


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def family(seed, n, edits, size=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_against_all_pairs(spark, k):
    texts = family(1, 60, 8) + family(2, 5, 2) + family(3, 30, 14, 300) + ["", None, "one", "One", "a b c", "a b c d e f", "A  b\tc d e f", "x " * 3000] + family(4, 20, 1, 9)
    docs = list(enumerate(texts, 100))
    random.Random(0).shuffle(docs)
    assert got(N.near_duplicates(frame(spark, docs), k)) == brute(docs, k)


def test_links_that_the_smallest_member_lacks(spark):
    """Copies edited so much that the smallest of a bucket isn't similar to the others still link through less edited ones."""
    texts = family(7, 150, 9, 150)
    docs = list(enumerate(texts))
    want = brute(docs, 4)
    assert len({c for _, c in want.values()}) > 1
    assert got(N.near_duplicates(frame(spark, docs), 4)) == want


def test_blocks_of_any_size_agree(spark):
    docs = list(enumerate(family(9, 60, 9, 150)))
    texts = frame(spark, docs).select("doc_id", "text")
    all_ = texts.select(F.lit(1).cast("long").alias("bucket"), "doc_id", F.col("doc_id").alias("component"))
    want = brute(docs, 4)
    for rows, chars in ((1024, 10**7), (7, 10**7), (1024, 5000)):
        links = N.block_links(all_, all_, texts, 4, (80, 100), rows=rows, chars=chars)
        label = {r["doc_id"]: r["component"] for r in N.components(links).collect()}
        assert {d: label.get(d, d) for d, _ in docs} == {d: c for d, (_, c) in want.items()}


def test_unlike_texts_under_one_id_both_stay(spark):
    say = lambda s: " ".join(f"{s}{i}" for i in range(40))
    docs = [(7, say("a")), (7, say("b")), (7, say("b")), (8, say("a")), (9, None), (9, "")]
    kept = sorted((r["doc_id"], r["text"] or "") for r in N.deduplicate(frame(spark, docs)).collect())
    assert kept == [(7, say("a")), (7, say("b")), (9, "")]


def test_band_recall_at_the_threshold():
    """Measured over pairs of similarity 0.8: the share that shares a band."""
    import pyarrow as pa

    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        base = [f"w{rng.randrange(10**7)}" for _ in range(90 + 3)]
        # 80 of 90 + 10 shingles are shared: ten at the end are replaced on one side, ten more on the other
        pairs += [" ".join(base[:83] + [f"x{rng.randrange(10**7)}" for _ in range(10)]), " ".join(base[:83] + [f"y{rng.randrange(10**7)}" for _ in range(10)])]
    batch = pa.record_batch({"doc_id": pa.array(range(800)), "text_key": pa.array([0] * 800), "text": pa.array(pairs)})
    bands = [set(r["bands"]) for r in pa.Table.from_batches(N._sign(iter([batch]), 4)).to_pylist()]
    assert sum(bool(bands[i] & bands[i + 1]) for i in range(0, 800, 2)) >= 399


def test_repeated_rows_nulls_and_empty_tables(spark):
    docs = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (4, "")]
    out = N.near_duplicates(frame(spark, docs), 4).collect()
    assert len(out) == 6
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True)}
    assert N.near_duplicates(frame(spark, []), 4).count() == 0
    kept = N.deduplicate(frame(spark, docs))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    label = {r["doc_id"]: r["component"] for r in N.components(edges).collect()}
    assert {label[i] for i in range(61)} == {0} and label[101] == label[100] == 100


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    limit = N.sketch_limit(0.6)
    import pyarrow as pa

    for share in (0.85, 0.3):
        a = [f"w{i}" for i in rng.integers(0, 10**6, 500)]
        b = a[: int(500 * 2 * share / (1 + share))] + [f"v{i}" for i in rng.integers(0, 10**6, 500 - int(500 * 2 * share / (1 + share)))]
        batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text_key": pa.array([0, 0]), "text": pa.array([" ".join(a), " ".join(b)])})
        out = pa.Table.from_batches(N._sign(iter([batch]), 4)).to_pylist()
        apart = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(out[0]["sketch"], out[1]["sketch"], strict=True))
        assert (apart <= limit) == (share > 0.6)


def test_long_and_odd_texts_hash_alike():
    import pyarrow as pa

    long = "word " * 900_000
    buf, off = T.string_buffer(pa.array([long, "WORD", "é É", None]))
    w = T.words(buf, off)
    assert list(np.diff(w.first)) == [900_000, 1, 2, 0]
    assert len(np.unique(w.hash[:900_001])) == 1 and w.hash[-1] != w.hash[-2]
