"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Per document: word, symbol, repeated-line and repeated-trigram counts, computed inside
the row. Across documents: each normalised line (words joined by one space, A-Z
lower-cased) is hashed, its distinct documents are counted per host (``source``), and
lines found in more than LINE_ROOT times the root of the number of the host's documents
are removed: verdicts count what that takes, and good_documents returns the texts
without them. A document that loses DEPLETED_PERCENT of its distinct lines' words, or
more, is rejected.

Documents of a host are told apart by text hash: exact copies are one document, so a
page does not become boilerplate by being crawled often. The root is one rule for hosts
of every size; a share would let a passage stand in thousands of documents of a hot
host, a fixed count would clear a large host of its ordinary short lines. Equal texts on
a host share one verdict, which also settles repeated rows.

Defined results: a null text counts as empty; a null source is the host ''; a document
without words fails the base rule; repeated rows are each answered; a text is split and
hashed whole, however long; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspan.llm.common import cut, unused

LINE_ROOT = 1.0
DEPLETED_PERCENT = 30

_WS = " \t\n\x0b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for the row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without_blanks(text: Column) -> Column:
    return F.translate(text, _WS, "")


def _words(text: Column) -> Column:
    # translate and split on one literal byte: far cheaper than a regular expression
    return F.filter(F.split(F.translate(text, _WS, " " * len(_WS)), " "), lambda w: w != "")


def _plain_lines(text: Column) -> Column:
    """A text's lines as they are compared: their words, A-Z lower-cased, joined by one space; line breaks are as in the text."""
    blanks = _WS.replace("\n", "")
    return F.split(F.regexp_replace(F.translate(text, blanks + _UPPER, " " * len(blanks) + _LOWER), " {2,}", " "), "\n")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first time included.

    The windows' hashes are sorted with their positions; equal neighbours mark repeated
    windows, whose sorted positions cover min(3, distance to the next) words each.
    """

    def covered(at: Column) -> Column:
        each = F.transform(at, lambda p, i: F.when(i == F.size(at) - 1, F.lit(3)).otherwise(F.least(F.lit(3), F.get(at, i + 1) - p)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    def repeated(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), (F.get(s, i - 1)["h"] == x["h"]), (F.get(s, i + 1)["h"] == x["h"]), F.lit(False))), lambda x: x["p"]))

    def of(w: Column) -> Column:
        keys = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
        return _let(F.sort_array(F.slice(keys, 1, F.size(w) - 2)), lambda s: _let(repeated(s), covered))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(of(words))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the contract's counts, and (host, text_key) of every row."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: _without_blanks(x) != "")
    packed = _let(_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    return base.select(
        "doc_id", "host", F.xxhash64("text").alias("text_key"), packed.alias("w"),
        F.length(_without_blanks(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines(F.col("text")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "host", "text_key", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(host, text_key, line_key, n): the normalised lines of each distinct text and their word counts."""
    text = F.coalesce("text", F.lit(""))
    keyed = lambda x: F.struct(F.xxhash64(x).alias("line_key"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("n"))
    lines = F.array_distinct(F.transform(F.filter(F.transform(_plain_lines(text), lambda x: F.trim(x)), lambda x: x != ""), keyed))
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("text_key"), F.explode(lines).alias("l"))
    return rows.select("host", "text_key", "l.line_key", "l.n").distinct()


def common_lines(docs: DataFrame, root: float = LINE_ROOT) -> DataFrame:
    """(host, line_key) of the lines above their host's limit."""
    limits = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")).distinct()
    limits = limits.groupBy("host").agg((F.sqrt(F.count("*").cast("double")) * F.lit(root)).alias("most"))
    common = distinct_lines(docs).groupBy("host", "line_key").agg(F.count("*").alias("n_texts"))
    return common.join(limits, "host").filter("n_texts > most").select("host", "line_key")


def without_lines(docs: DataFrame, common: DataFrame) -> DataFrame:
    """docs without the lines of common (host, line_key) in their texts; the other columns stay, but an n_chars follows its text.

    A host has fewer common lines than LINE_ROOT ** -1 times the root of its documents' number times
    the lines of a document, so they are joined as one array by host.
    """
    there, gone, left_ = (unused(docs.columns, n) for n in ("__ch", "__cut", "__left"))
    cuts = common.groupBy(F.col("host").alias(there)).agg(F.collect_set("line_key").alias(gone))
    joined = docs.join(cuts, F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(there), "left")
    keys = F.transform(_plain_lines(F.col("text")), lambda x: F.xxhash64(F.trim(x)))

    def left(h: Column) -> Column:
        rest = lambda hit: F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(hit, F.get(h, i))), "\n")
        # most texts hold none of their host's common lines, and the others one or two of them
        return _let(F.array_intersect(h, gone), lambda hit: F.when(F.size(hit) == 0, F.col("text")).otherwise(rest(hit)))

    joined = joined.withColumn(left_, F.when(F.col(gone).isNull(), F.col("text")).otherwise(_let(keys, left)))
    put = {"text": F.col(left_)}
    if "n_chars" in docs.columns:
        n = F.length(left_).cast(docs.schema["n_chars"].dataType)
        put["n_chars"] = F.when(F.col(left_).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(n)
    return joined.select(*[put[c].alias(c) if c in put else F.col(f"`{c}`") for c in docs.columns])


def depleted_texts(docs: DataFrame, common: DataFrame, percent: int = DEPLETED_PERCENT) -> DataFrame:
    """(host, text_key, n_removed) of the texts that lose too many of their words to the lines of common (host, line_key)."""
    lines = distinct_lines(docs)
    common = common.select("host", "line_key", F.lit(True).alias("common"))
    lost = lines.join(common, ["host", "line_key"], "left").groupBy("host", "text_key").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("common"), F.col("n")).otherwise(0)).alias("n_removed"))
    return lost.filter(F.col("n_removed") * 100 >= F.col("n_all") * percent).filter("n_removed > 0").select("host", "text_key", "n_removed")


def quality_verdicts(docs: DataFrame, root: float = LINE_ROOT, percent: int = DEPLETED_PERCENT) -> DataFrame:
    """The contract's columns of every row of docs (doc_id, text, source)."""
    stats = document_statistics(docs)
    bad = depleted_texts(docs, common_lines(docs, root), percent).select("host", "text_key", F.lit(True).alias("depleted"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return stats.join(bad, ["host", "text_key"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("depleted").isNull()).alias("kept"),
    )


def good_documents(docs: DataFrame, root: float = LINE_ROOT, percent: int = DEPLETED_PERCENT) -> DataFrame:
    """docs without the rejected ones, and without the lines above limits in the texts of the others.

    The verdict is the text's and host's, so no key column is needed.
    """
    text, host = F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    h, k, s, bh, bk = (unused(docs.columns, n) for n in ("__h", "__k", "__s", "__bh", "__bk"))
    base = docs.withColumn(h, host).withColumn(k, F.xxhash64(text))
    base = base.withColumn(s, _let(_words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))))
    base = base.filter((F.col(s)["n"] >= 50) & (F.col(s)["r"] * 100 <= F.col(s)["n"] * 50)).drop(s)
    common = cut(common_lines(docs, root), "common-lines")
    bad = cut(depleted_texts(docs, common, percent).select(F.col("host").alias(bh), F.col("text_key").alias(bk)), "depleted")
    kept = base.join(bad, (F.col(h) == F.col(bh)) & (F.col(k) == F.col(bk)), "left_anti").drop(h, k)
    return without_lines(kept, common)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3
), t AS (
  SELECT g.rid, g.i, ws[g.i] || ' ' || ws[g.i + 1] || ' ' || ws[g.i + 2] AS k FROM g JOIN w USING (rid)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM t) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid
), l AS (
  SELECT DISTINCT host, text, array_to_string(list_filter(string_split_regex(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda y: y <> ''), ' ') AS line
  FROM (SELECT host, text, unnest(ls) AS x FROM w)
), n AS (
  SELECT host, line, count(*) AS c FROM l GROUP BY 1, 2
), h AS (
  SELECT host, sqrt(count(DISTINCT text)) AS most FROM d GROUP BY 1
), x AS (
  SELECT l.host, l.text, sum(len(string_split(line, ' '))) AS n_all, coalesce(sum(len(string_split(line, ' '))) FILTER (WHERE n.c > h.most), 0) AS n_removed
  FROM l JOIN n USING (host, line) JOIN h USING (host) GROUP BY 1, 2
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::BIGINT AS word_chars,
  length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  (len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws)) AS base_failed,
  NOT (len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws)) AND NOT coalesce(n_removed > 0 AND 100 * n_removed >= 30 * n_all, false) AS kept
FROM w LEFT JOIN rep USING (rid) LEFT JOIN x ON x.host = w.host AND x.text = w.text
"""
