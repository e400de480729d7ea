"""Mixing sources to target weights with exact block quotas and a splitting tree.

Documents are cut into blocks of ``block_words`` words.  Targets by source are
the fill level of a water-filling: shares of ``budget`` times all words by
weight, none above ``repeats`` times its source, the excess shared again by
weight.  Each repeat ("epoch") of a source has its own permutation of the
source's blocks, and the mix takes a prefix of it: all but the last epoch whole.

The number of blocks so drawn by each source is its quota.  A binary tree over
the output shards splits the vector of quotas exactly: each node draws its left
half's part from the multivariate hypergeometric law, by numbers hashed from the
seed, the node and the source, and gives the rest to the right.  A leaf's quotas say how many blocks of each source a shard gets, and the
running sums over shards which ranks of the permutation they are, so shards draw
disjoint blocks.  Within a shard blocks are put in an order of their own.

Only DataFrame functions touch rows.  Ranks come in two levels: blocks fall into
buckets by their permutation's hash, prefix sums run over buckets, and rows are
numbered within a bucket, so no task sorts a source.  The driver sees one row
for each source and epoch, and makes (sources x epochs x shards) quotas.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Fewest blocks that a bucket holds on average.  Buckets hold the square root of all blocks, and so many they are: neither sums over buckets nor ranks within one grow in step with the input.
BUCKET_BLOCKS = 512


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, source, digest, size): a number of each row's own, 64 bits of its text's MD5, and the words of the text, 0 where it is null."""
    text = common.text_or_empty(text_col)
    size = F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size")
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), _digest(text).alias("_digest"), size)


def _digest(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def targets(sized: DataFrame, weights: list[int], budget: tuple[int, int] = (3, 2), repeats: int = 2) -> DataFrame:
    """(source, source_size, target) by water-filling.

    Sources stand by code point, null last, and take the weights in turn.
    ``budget`` is a fraction of all words.  The windows run over one row for each
    source.
    """
    by = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    every, order = W.partitionBy(F.lit(1)), W.partitionBy(F.lit(1)).orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * repeats)
    fill = W.partitionBy(F.lit(1)).orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    free = F.sum("source_size").over(every) * budget[0] / F.lit(float(budget[1])) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = free / F.sum("_w").over(fill.rowsBetween(0, W.unboundedFollowing))
    # the first source, by cap for its weight, that the level leaves below its cap sets the level of all from there on
    by = by.withColumn("_level", level).withColumn("_k", F.row_number().over(fill))
    by = by.withColumn("_open", F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_k"))).over(every))
    by = by.withColumn("_final", F.max(F.when(F.col("_k") == F.col("_open"), F.col("_level"))).over(every))
    return by.select("_source", "source_size", F.when(F.col("_k") >= F.col("_open"), F.col("_final") * F.col("_w")).otherwise(F.col("_cap").cast("double")).alias("target"))


def _hash(seed: int, *parts: Column) -> Column:
    """60 bits of MD5, alike in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def _place(seed: int) -> Column:
    return _hash(seed, F.col("epoch"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_digest"), F.col("block"))


def draws(sized: DataFrame, goal: DataFrame, block_words: int, repeats: int, seed: int) -> DataFrame:
    """All blocks of all epochs with ``drawn``, and ``rank``, the place among the drawn blocks of their source and epoch (from 0).

    A block is drawn where the words before it and half its own stay within what
    its source takes from its epoch, which makes the drawn ones a prefix of the
    permutation and the words drawn the nearest to the target.  Rows of one id
    and text have equal hashes and stand side by side.
    """
    n_blocks = F.ceil(F.col("size") / block_words).cast("int")
    epochs = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch")
    rows = sized.where("size > 0").select("_row", "_id", "_source", "_digest", "size", epochs).select("*", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    words = F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).cast("long")
    rows = rows.select("_row", "_id", "_source", "_digest", "epoch", "block", words.alias("words"), _place(seed).alias("_h"))
    total = sized.agg(F.sum(F.ceil(F.col("size") / block_words))).first()[0] or 0
    span = (1 << 60) // max(1, total // max(BUCKET_BLOCKS, math.isqrt(total))) + 1
    rows = rows.withColumn("_bucket", F.floor(F.col("_h") / span))
    # "/" is floating point: a hash near an edge could round into the next bucket, alike for equal hashes, and order is kept all the same
    keys = ["_source", "epoch", "_bucket"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("words").alias("_words"))
    before = W.partitionBy("_source", "epoch").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select(*keys, F.coalesce(F.sum("_n").over(before), zero).alias("_n0"), F.coalesce(F.sum("_words").over(before), zero).alias("_w0"))
    key = [F.coalesce("_source", F.lit("")), F.col("_source").isNull()]
    sums = sums.join(goal.select(F.col("_source").alias("_s"), "source_size", "target"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    sums = sums.withColumn("_take", F.least(F.greatest(F.col("target") - F.col("epoch") * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double")))
    inside = W.partitionBy(*key, "epoch", "_bucket").orderBy("_h", "_id", "_digest", "block", "_row")
    rows = rows.withColumn("_k", F.row_number().over(inside) - 1).withColumn("_sum", F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    sums = sums.select(key[0].alias("_s0"), key[1].alias("_s1"), F.col("epoch").alias("_e"), F.col("_bucket").alias("_b"), "_n0", "_w0", "_take")
    joined = rows.join(sums, (key[0] == F.col("_s0")) & (key[1] == F.col("_s1")) & (F.col("epoch") == F.col("_e")) & (F.col("_bucket") == F.col("_b")))
    return joined.select(
        "_row", "_id", "_source", "_digest", "epoch", "block", "words", (F.col("_n0") + F.col("_k")).alias("rank"),
        ((F.col("_w0") + F.col("_sum")) * 2 - F.col("words") <= F.col("_take") * 2).alias("drawn"),
    )


def hypergeometric(u: float, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from good + bad without putting back are good: inverse of the distribution at ``u``, taken upward from its mode and then downward."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    # weights relative to the mode's; far from it they vanish
    up, down, p, k = [], [], 1.0, mode
    while k < high and p > 1e-18:
        p *= (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))
        k += 1
        up.append(p)
    p, k = 1.0, mode
    while k > low and p > 1e-18:
        p *= k * (bad - n + k) / ((good - k + 1) * (n - k + 1))
        k -= 1
        down.append(p)
    u = u * (1.0 + math.fsum(up) + math.fsum(down)) - 1.0
    if u < 0:
        return mode
    for side, sign in ((up, 1), (down, -1)):
        for i, w in enumerate(side):
            u -= w
            if u < 0:
                return mode + sign * (i + 1)
    return mode


def uniform(seed: int, *parts: int) -> float:
    """A number in [0, 1) from 60 bits of MD5."""
    return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode(), usedforsecurity=False).hexdigest()[:15], 16) / 2**60


def split(quotas: list[int], n: int, seed: int, first: int = 0) -> list[list[int]]:
    """The quotas' parts for each of ``n`` shards whose sizes differ by one at most, by the splitting tree; the node's number is its first shard's and ``n``."""
    if n == 1:
        return [list(quotas)]
    left_n, total = n // 2, sum(quotas)
    # leaves take total // n each, and the first total % n of them one more
    take = left_n * (total // n) + min(left_n, total % n)
    left, rest, need = [], total, take
    for i, q in enumerate(quotas):
        x = hypergeometric(uniform(seed, first, n, i), q, rest - q, need)
        left.append(x)
        rest, need = rest - q, need - x
    return split(left, left_n, seed, first) + split([q - x for q, x in zip(quotas, left, strict=True)], n - left_n, seed, first + left_n)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: tuple[int, int] = (3, 2), repeats: int = 2, block_words: int = 256, shards: int = 16, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, targets, blocks): the mix's blocks with the shard that each goes to and its place there.

    ``blocks`` has _row, _id, _source, _digest, epoch, block, words, shard and
    order; ``_row`` is the row's number in ``sizes``.  Null sources are a source
    of their own; documents without words have no block.  The same table and seed
    give the same mix however the rows are dealt; which of some rows that repeat
    an id, a source and a text is drawn is left open.
    """
    spark = docs.sparkSession
    sized = common.stored(sizes(docs, id_col, text_col, source_col), "sizes")
    goal = common.stored(targets(sized, list(weights), budget, repeats), "targets")
    drawn = common.stored(draws(sized, goal, block_words, repeats, seed).where("drawn").drop("drawn"), "draws")
    quotas = drawn.groupBy("_source", "epoch").agg(F.count("*").alias("n")).orderBy(F.col("_source").asc_nulls_last(), "epoch").collect()
    parts = split([r["n"] for r in quotas], shards, seed) if quotas else []
    rows, cut = [], [0] * len(quotas)
    for part in parts:
        cut = [a + b for a, b in zip(cut, part, strict=True)]
        rows.append(cut)
    ends = [{"_s": r["_source"], "_e": r["epoch"], "ends": [row[i] for row in rows]} for i, r in enumerate(quotas)]
    cuts = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<_s:string,_e:int,ends:array<bigint>>>")))
    if len(ends) * shards <= 1_000_000:  # 8 MB of quotas; beyond that, the adaptive join splits a large source
        cuts = F.broadcast(cuts)
    # a block's shard: how many shards' ranges end at its rank or before; (sources x epochs) rows of (shards) numbers are joined
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    placed = drawn.join(cuts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e"))).drop("_s", "_e")
    blocks = placed.select("_row", "_id", "_source", "_digest", "epoch", "block", "words", shard.alias("shard"), _place(seed + 1).alias("order"))
    return sized, goal, blocks


def report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **more) -> DataFrame:
    """Per row: size, source_size, target, taken, ``blocks`` taken, ``shards`` they are in and ``dealt``, those shards and how many blocks each holds.

    Rows that repeat an id are rows of their own, each with its size and its
    taken words.
    """
    sized, goal, blocks = mix(docs, id_col, source_col=source_col, **more)
    held = blocks.groupBy("_row", "shard").agg(F.sum("words").alias("words"), F.count("*").alias("n"))  # a row has as many groups as there are shards at most
    each = F.array_sort(F.collect_list(F.struct("shard", "n")))
    taken = held.groupBy("_row").agg(F.sum("words").alias("taken"), F.sum("n").alias("blocks"), F.count("*").alias("shards"), each.alias("_each"))
    taken = taken.withColumn("dealt", F.array_join(F.transform("_each", lambda x: F.concat_ws(":", x["shard"], x["n"])), ","))
    zero, null = F.lit(0).cast("long"), [F.coalesce("_source", F.lit("")).alias("_s0"), F.col("_source").isNull().alias("_s1")]
    return sized.select("*", *null).join(taken, "_row", "left").join(goal.select(*null, "source_size", "target"), ["_s0", "_s1"], "left").select(
        F.col("_id").alias(id_col), "size", "source_size", "target", *[F.coalesce(c, zero).alias(c) for c in ("taken", "blocks", "shards")], F.coalesce("dealt", F.lit("")).alias("dealt")
    )


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 1 << 30, **more) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as a block of it was drawn, all columns as they are, by shard and by the order within it.

    With blocks as large as any document, documents are drawn whole.  Documents
    without words have nothing to draw and are left out.  Of rows that repeat an
    id, a source and a text, as many are taken in each epoch as were drawn.
    """
    sized, goal, blocks = mix(docs, id_col, text_col, source_col, block_words=block_words, **more)
    name = [F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_key"), F.coalesce(F.col("_source"), F.lit("")).alias("_s0"), F.col("_source").isNull().alias("_s1"), F.col("_digest")]
    names = ["_key", "_s0", "_s1", "_digest"]
    times = blocks.groupBy("_row", "epoch", *name).agg(F.min(F.struct("shard", "order")).alias("_at")).groupBy("epoch", *names).agg(F.min("_at").alias("_at"), F.count("*").alias("_n"))
    # rows go into a struct, so their columns may have any names
    own = docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_key"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("_s0"), F.col(f"`{source_col}`").isNull().alias("_s1"), _digest(common.text_or_empty(f"`{text_col}`")).alias("_digest"),
    )
    same = common.stored(sized.where("size > 0").groupBy(*name).count().where("count > 1").drop("count"), "repeats")
    if same.isEmpty():
        own = own.withColumn("_copy", F.lit(1))
    else:
        copies = own.join(same, names, "left_semi").withColumn("_copy", F.row_number().over(W.partitionBy(*names).orderBy(F.lit(0))))
        own = own.join(same, names, "left_anti").withColumn("_copy", F.lit(1)).unionByName(copies)
    common.drop(sized, goal)
    # a range sort: files in the order of their names hold shard after shard, each in its own order
    return own.join(times, names).where("_copy <= _n").orderBy("_at.shard", "_at.order", "_key", "epoch").select("_row.*")
