"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions alone.

A logged conversation is often the beginning of a longer one. Turns are ranked within
their conversation, each turn's hash takes its rank in, and the running XOR of two such
hashes identifies every prefix. A conversation whose whole hash is another's proper
prefix is dropped by an anti-join; of equal conversations the smallest conv_id stays.
What remains is rendered, one string a conversation.

Only hashes meet in the joins, after pre-aggregation to distinct ones, so neither a
common first turn nor a conversation logged many times makes a hot group.

Defined results: turns are ordered by (turn, role, text), nulls first; a row that
repeats is a turn of its own; a null role renders as 'none', a null text as nothing, and
both differ from empty strings in comparison; a conversation is one string, however long.
Rows with a null conv_id belong to no logged conversation that could be told from others:
each is a conversation of one turn, so their number makes no large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL = "<|", "|>"
END = "<|end|>"


def _turn_hash(n: int, k: Column) -> Column:
    return F.xxhash64(F.lit(n), k, F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, hash_a, hash_b, role, text): each turn with its rank, the conversation's length, and the prefix hash up to it."""
    rows = turns.select("conv_id", "turn", "role", "text")
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    ranked = rows.filter("conv_id IS NOT NULL").withColumn("k", F.row_number().over(by))
    hashed = ranked.withColumn("a", _turn_hash(1, F.col("k"))).withColumn("b", _turn_hash(2, F.col("k")))
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = hashed.select("conv_id", "k", F.max("k").over(whole).alias("n"), F.bit_xor("a").over(upto).alias("hash_a"), F.bit_xor("b").over(upto).alias("hash_b"), "role", "text")
    lone = rows.filter("conv_id IS NULL").select("conv_id", F.lit(1).alias("k"), F.lit(1).alias("n"), _turn_hash(1, F.lit(1)).alias("hash_a"), _turn_hash(2, F.lit(1)).alias("hash_b"), "role", "text")
    return known.unionByName(lone)


_KEY = ("k", "hash_a", "hash_b")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, k, hash_a, hash_b, n_equal) of the conversations that no longer one begins with; k is the number of turns."""
    # equal conversations meet in a partial aggregation first: the anti-join has no hot key
    full = prefixes.filter("k = n").groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    return full.join(prefixes.filter("k < n").select(*_KEY).distinct(), list(_KEY), "left_anti").select("conv_id", *_KEY, "n_equal")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered) of the maximal conversations of turns (conv_id, turn, role, text).

    The turns of dropped conversations leave by the join, before anything is rendered.
    """
    prefixes = turn_prefixes(turns)
    kept = maximal(prefixes).withColumn("n_turns", F.col("k").cast("long"))
    one = F.concat(F.lit(HEAD), F.coalesce("role", F.lit("none")), F.lit(TAIL), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END))
    whole = kept.filter("conv_id IS NOT NULL").select("conv_id", "n_turns", "n_equal")
    lines = prefixes.select("conv_id", F.struct("k", one.alias("line")).alias("turn")).join(whole, "conv_id")
    rendered = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["line"]), "\n").alias("rendered")
    out = lines.groupBy("conv_id", "n_turns", "n_equal").agg(rendered)
    # turns without a conversation of their own: equal ones are aggregated, not listed
    lone = prefixes.filter("conv_id IS NULL").groupBy(*_KEY).agg(F.max(one).alias("rendered")).join(kept.filter("conv_id IS NULL"), list(_KEY))
    return out.unionByName(lone.select("conv_id", "n_turns", "n_equal", "rendered"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT NULL, [{'r': role, 't': text}], 1 FROM conversations WHERE conv_id IS NULL
), e AS (
  SELECT l, n, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY 1, 2
), p AS (
  SELECT DISTINCT l[1 : k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM e)
)
SELECT conv_id, n::BIGINT AS n_turns, n_equal::BIGINT AS n_equal,
  array_to_string(list_transform(l, lambda x: '<|' || coalesce(x.r, 'none') || '|>' || chr(10) || coalesce(x.t, '') || '<|end|>'), chr(10)) AS rendered
FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = e.l)
"""
