"""Decontamination, quality rules, toxicity, quality scores, pieces: brute force, held-out accuracy, exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspan.llm import decontaminate as D
from panelspan.llm import piece_sampling as P
from panelspan.llm import quality_classifier as C
from panelspan.llm import quality_rules as Q
from panelspan.llm import toxicity as X

DOCS = "doc_id long, text string, source string, score double, spans string, items string, host string, text_key long"


def docs(spark, texts, start=0, source="s"):
    return spark.createDataFrame([(i, t, source, 0.0, "x", "x", "h", 5) for i, t in enumerate(texts, start)], DOCS)


def alnum(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(texts, items):
    wins = {}
    for name, t in items:
        w = alnum(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = {}
    for d, t in enumerate(texts):
        w, hit, names = alnum(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    names |= wins[tuple(w[i : i + n])]
        names = sorted(x for x in names if x is not None)
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def bench_case():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(40)] + ["the"] * 10
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [("10", say(25)), ("9", say(10)), ("2", "Short item-Here"), ("3", "the the the"), ("4", ""), ("5", None), ("2", say(14)), (None, say(12)), ("7", "the " * 30)]
    texts = [say(60) + " " + (items[i % 9][1] or "") + " " + say(40) for i in range(40)]
    texts += ["", None, "short ITEM here", "the " * 50, (items[0][1] + "! ").replace(" ", "\n") * 3, "x" * 200_000, items[1][1].rsplit(" ", 1)[0]]
    return texts, items


@pytest.mark.parametrize("shard", [10**6, 60])
def test_decontamination_against_brute_force(spark, shard):
    texts, items = bench_case()
    b = spark.createDataFrame(items, "item_id string, text string")
    out = D.digest(D.contamination(docs(spark, texts), b, shard_chars=shard)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == brute_hits(texts, items)


def test_shards_whose_items_share_a_prefix_or_a_suffix(spark):
    """Whole items of one shard over parts of items of another: equal starts with other ends, and equal ends with other starts."""
    w = [f"w{i}" for i in range(60)]
    said = lambda *a: " ".join(a)
    items = [(str(k), said(*w[:30])) for k in range(4)] + [(str(k), said(*w[:15], f"x{k}")) for k in range(4, 12)] + [(str(k), said(f"y{k}", *w[15:30])) for k in range(12, 20)] + [("20", said(*w[40:55]))]
    texts = [said("a", *w[:30], "b"), said("a", *w[:30], "b", *w[40:55], "c"), said(*w[:15], "b", *w[40:55]), said("a", *w[15:30], "b"), said("a", *w[10:30], "b")]
    b = spark.createDataFrame(items, "item_id string, text string")
    for shard in (10**6, 100, 400):
        out = D.digest(D.contamination(docs(spark, texts), b, shard_chars=shard)).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in out} == brute_hits(texts, items)


def test_decontamination_edges(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    d = docs(spark, ["a b c", None])
    assert not any(r["contaminated"] for r in D.digest(D.contamination(d, empty)).collect())
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(d.limit(0), b).count() == 0
    twice = d.union(d)
    assert D.contamination(twice, b).count() == 4
    odd = spark.createDataFrame([(None, "x a b y"), (None, "clean"), (7, "a b"), (7, "clean too")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in D.clean(odd, b).collect() if r["doc_id"]) == [(7, "clean too")] and D.clean(odd, b).count() == 2
    kept = D.clean(twice, b)
    assert kept.columns == d.columns and [r["text"] for r in kept.collect()] == [None, None]


def brute_rules(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_quality_rules_against_brute_force(spark):
    rng = random.Random(1)
    say = lambda n, v: " ".join(rng.choice(v) for _ in range(n))
    texts = ["", None, " \n\t ", "a", "a a a", "a a a a a", "#*$ é\vü\n\n#*$ é\vü", "x" * 5000, "a b c a b c", say(300, "abc"), say(80, [f"w{i}" for i in range(500)]), "l1\nl2\nl1\n l1"]
    out = {r["doc_id"]: r for r in Q.quality_verdicts(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = out[i], brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_depleted_documents_go_and_copies_stay(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    menu = say(60)
    shells = [f"{menu}\n{say(3)}" for _ in range(40)]
    plain = [f"{say(40)}\n{say(40)}" for _ in range(40)]
    copies = [plain[0]] * 60
    d = docs(spark, shells + plain + copies)
    out = Q.quality_verdicts(d, root=2).collect()
    assert {r["doc_id"] for r in out if not r["kept"]} == set(range(40))
    kept = Q.good_documents(d, root=2)
    assert kept.columns == d.columns and kept.count() == 100
    assert Q.quality_verdicts(d.limit(0)).count() == 0 and Q.good_documents(d.limit(0)).count() == 0


def test_good_documents_lose_the_lines_above_the_limit(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    heads, tails = [say(60) for _ in range(60)], [say(20) for _ in range(60)]
    license = "Licensed under  X by Somebody"
    texts = [f"{h}\n\n{license.upper() if i % 2 else license} \n{t}\n" if i < 30 else f"{h}\n{license if i < 35 else t}\n{t}" for i, (h, t) in enumerate(zip(heads, tails, strict=True))]
    rows = [(i, t, "a" if i < 30 else "b" if i < 59 else None, len(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    kept = Q.good_documents(d)
    assert kept.schema == d.schema
    got = {r["doc_id"]: r for r in kept.collect()}
    want = {i: f"{heads[i]}\n\n{tails[i]}\n" if i < 30 else texts[i] for i in range(60)}  # five texts of host b are under the limit
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_quality_verdicts_against_their_sql(spark):
    """Depleted documents among others, repeated rows, null sources, clashing names: every row equals the SQL twin's."""
    import duckdb

    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    menu, notice = say(25), say(12)
    rows = []
    for i in range(60):
        source = ("a", "a", "b", None)[i % 4]
        rows.append((i, f"{say(55)}\n{menu.upper() if i % 3 else menu}\n {notice}" if i % 2 else f"{say(60)}\n{notice}", source))
    rows += [rows[1], rows[1], (None, rows[3][1], "a"), (77, None, None), (78, "", "a"), (79, "x" * 100_000, "a"), (80, "a b c " * 30_000, "a")]
    d = spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], "doc_id long, text string, source string, n_words int, host string, h int, __h int")
    con = duckdb.connect()
    con.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in Q.quality_verdicts(d).collect()), key=key)
    assert got == sorted(con.sql(Q.ORACLE).fetchall(), key=key)
    assert any(not r[-2] and not r[-1] for r in got) and any(r[-1] for r in got)
    kept = Q.good_documents(d)
    assert kept.columns == d.columns and kept.count() == sum(r[-1] for r in got)


def toxic_case(n=600):
    rng = random.Random(5)
    say = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    texts, toxic = [], []
    for i in range(n):
        w, bad = say(rng.randint(20, 80)), i % 6 == 0
        for _ in range(4 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["grimbly", "snarkos", "vilethou", "vilerean"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_held_out(spark):
    texts, toxic = toxic_case()
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i < 400], "doc_id long, toxic int")
    model = X.toxicity_model(d, labels)
    score = {r["doc_id"]: r["s"] for r in X.toxicity(d, model, ("doc_id", "text", "score"), "s").collect()}
    assert all(0 <= s <= 1 for s in score.values())
    right = [(score[i] >= 0.5) == bool(toxic[i]) for i in range(400, 600)]
    assert np.mean(right) > 0.97
    kept = X.acceptable(d, labels)
    assert kept.columns == d.columns and abs(kept.count() - 500) <= 6


def test_models_don_t_depend_on_who_is_broadcast(spark):
    texts, toxic = toxic_case(240)
    d = docs(spark, texts + texts[:3])
    labels = spark.createDataFrame([(i, t, 1 - t) for i, t in enumerate(toxic) if i < 200], "doc_id long, toxic int, quality int")
    for fit, score in ((X.toxicity_model, lambda m: X.toxicity(d, m)), (C.quality_model, lambda m: C.quality(d, m))):
        a, b = ({(r["doc_id"], round(r["score"], 6)) for r in score(fit(d, labels, most_broadcast=n)).collect()} for n in (10**6, 0))
        assert a == b


def test_toxicity_edges(spark):
    d = docs(spark, ["", None, "a b", "a b", "z " * 100_000])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.toxicity(d, X.toxicity_model(d, none)).filter("score between 0 and 0.5").count() == 5
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 1)], "doc_id long, toxic int")
    assert X.toxicity(d.union(d), X.toxicity_model(d.union(d), nulls)).count() == 10
    assert X.acceptable(d.limit(0), none).count() == 0


def test_nnpu_never_descends_below_zero_risk():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(2, 1, (300, 3)), rng.normal(0, 1, (700, 3))])
    w, b = X.fit_nnpu(x, np.arange(1000) < 200, 0.125)
    assert ((x @ w + b > 0)[:300].mean() > 0.8) and ((x @ w + b > 0)[300:].mean() < 0.1)


def test_quality_scores_held_out(spark):
    rng = random.Random(8)
    texts, good = [], []
    for i in range(800):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 90))]
        bad = i % 5 == 0
        texts.append(" ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + ".")
        good.append(int(not bad))
    d = docs(spark, texts + ["", None])
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good) if i < 500] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = C.quality_model(d, labels)
    score = {r["doc_id"]: r["score"] for r in C.quality(d, model).collect()}
    assert len(score) == 802 and all(0 <= s <= 1 for s in score.values())
    assert np.mean([(score[i] >= 0.7) == bool(good[i]) for i in range(500, 800)]) > 0.98


def test_quality_without_labels(spark):
    d = docs(spark, ["a b", ""])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in C.quality(d, C.quality_model(d, none)).collect()} == {0.5}


def test_isotonic():
    assert list(C.isotonic(np.array([1.0, 1, 0, 2, 1]), np.array([0.0, 1, 0, 1, 1]))) == pytest.approx([0, 2 / 3, 2 / 3, 2 / 3, 1])


@pytest.fixture(scope="module")
def pieces(spark):
    try:
        return P.vocabulary(spark)
    except Exception:
        pytest.skip("no vocabulary file")


TEXTS = ["", None, " ", "  a  b ", "Hello world\n\nnew", "▁▁ x▁y", "日本語 emoji 🙂 \x00\x01", "a" * 3000, "naïve café\t|#", " lead", "trail ", "\n", "é" * 50]


def test_pieces_decode_exactly_and_repeat(spark, pieces):
    d = docs(spark, TEXTS)
    out = P.encode(d, pieces, keep=("doc_id", "source"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(r["lossless"] for r in got.values())
    back = {r["doc_id"]: r["text"] for r in P.decode(out, pieces).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS
    again = {r["doc_id"]: r["ids"] for r in P.encode(d.repartition(3), pieces).collect()}
    assert again == {i: r["ids"] for i, r in got.items()}
    assert P.encode(d.limit(0), pieces).count() == 0
    assert got[0]["ids"] == [] and got[1]["ids"] is None


def test_pieces_of_long_texts(spark, pieces):
    """Long texts are sampled in parts, to the ids that they would get in one; runs without spaces are cut."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeé▁\n") for _ in range(rng.randint(1, 9))) for _ in range(150_000)), "x" * 700_000, " " * 700_000, "日" * 300_000, "short"]
    out = {r["doc_id"]: r for r in P.encode(docs(spark, texts), pieces).collect()}
    assert all(r["lossless"] for r in out.values())
    lat = P.Lattices(pieces.value)
    some = lat.pattern.findall(" " + texts[0])
    assert max(map(len, lat.pattern.findall(" " + texts[1]))) <= P.SEGMENT + 1
    seed = P.T.mix(np.array([spark.range(1).select(F.xxhash64(F.lit(0).cast("long"))).first()[0]], np.int64).view(np.uint64) + np.uint64(P.SEED))
    assert lat.sample(*lat.segments([some]), seed)[0].tolist() == out[0]["ids"]


def test_a_long_text_needs_little_memory():
    """8 MB of text in a process of its own stay under 400 MB."""
    import subprocess
    import sys

    code = """
import resource, sys, types, random
import numpy as np, pyarrow as pa
from panelspan.llm import piece_sampling as P
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(60_000)]
text = " ".join(rng.choices(words, k=1_250_000))
p = types.SimpleNamespace(value=P.Pieces(P.read_vocabulary()))
batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([text]), "row_seed": pa.array([5])})
out = list(P._encode(iter([batch]), p, 1))
assert out[0].column("lossless")[0].as_py()
print(len(text) >> 20, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    if done.returncode and "No such file" in done.stderr:
        pytest.skip("no vocabulary file")
    size, mb = map(int, done.stdout.split())
    assert size >= 7 and mb < 400


def test_repeated_rows_and_odd_columns_of_pieces(spark, pieces):
    d = docs(spark, ["a b c", "d e"])
    out = P.encode(d.union(d), pieces, keep=("doc_id", "items", "spans")).collect()
    assert len(out) == 4 and len({tuple(r["ids"]) for r in out}) == 2 and all(r["items"] == "x" for r in out)


def test_sampling_follows_the_lattice_weights():
    """Shares of sampled segmentations of one word against those of all paths, enumerated."""
    vocab = [("<unk>", "other", 0.0), *[(f"<0x{b:02X}>", "byte", 0.0) for b in range(256)]] + [(p, "normal", -float(i)) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "▁ab", "c"])]
    lat = P.Lattices(P.Pieces(vocab, 1.0))
    weight = {p: 1 / (i + 2) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "▁ab", "c"])}

    def paths(s):
        if not s:
            yield (), 1.0
        for n in range(1, len(s) + 1):
            if s[:n] in weight:
                for rest, w in paths(s[n:]):
                    yield (s[:n], *rest), w * weight[s[:n]]

    want = dict(paths("▁abc"))
    total = sum(want.values())
    n = 20_000
    ids, first = lat.sample(*lat.segments([[" abc"]] * n), np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seen = {}
    for a, b in zip(first[:-1], first[1:], strict=True):
        k = tuple(vocab[i][0] for i in ids[a:b])
        seen[k] = seen.get(k, 0) + 1
    assert set(seen) == set(want)
    for k, w in want.items():
        assert abs(seen[k] / n - w / total) < 0.015


def test_stages_remove_what_they_should_and_keep_clean_rows(spark, tmp_path):
    """The pipeline against its stages' brute-force decisions on a small corpus."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    say = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    clean = [say(80) for _ in range(60)]
    bench = say(30)
    texts = clean + [clean[0], clean[1] + " end", "too short", "a b c " * 40, say(30) + " " + bench + " " + say(30)]
    bad = ["grimbly", "snarkos", "vilethou"]
    texts += [" ".join(bad[j % 3] if j % 12 == 0 else w for j, w in enumerate(say(80).split())) for _ in range(40)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 65)) for i in list(range(60)) + list(range(65, 95))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(60))
    assert all(r["lossless"] for r in out)


@pytest.mark.parametrize("rows", [0, 40])
def test_the_pipeline_takes_nulls_repeats_odd_columns_and_empty_tables(spark, tmp_path, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(13)
    say = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    texts = [say(70) for _ in range(rows)]
    docs_ = [(i, t, None if i % 2 else "s", i, "x") for i, t in enumerate(texts)]
    if rows:
        docs_ += [docs_[0], docs_[1], (None, say(70), "s", 1, "x"), (None, None, None, None, None), (7, say(70), "s", 1, "x"), (90, "", "s", 0, "x"), (91, say(40_000), "s", 1, "x")]
    spark.createDataFrame(docs_, "doc_id long, text string, source string, n_chars long, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 1), (3, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # repeated rows leave one; a null id, an id with two texts and a long text stay; null and empty texts go by the word count
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == ([(False, i) for i in sorted([*range(rows), 7, 91])] + [(True, 0)] if rows else [])
    assert all(r["lossless"] for r in out)
