"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 by (xxhash64 of doc_id, size and crc32, then these): any order that is the same in every run would do,
and this one cuts into even ranges without a look at the data. A Feistel network over ``a x b >= N`` cells permutes the
numbers; results of N or more walk the cycle until they fall below N. Position ``p`` goes to shard ``p mod shards``, slot
``p div shards``: counts differ by one at most, slots have no gaps, and ``place`` gives the place of any row number
without looking at any other row. All of it is DataFrame expressions.

Null ids and null texts are ordinary values (a null text has no bytes, so size 8 and the crc32 of nothing); rows that
repeat get numbers of their own; an empty table gives an empty result; columns beyond id and text are not read.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6


def grid(n: int) -> tuple[int, int]:
    """The two radices: their product is at least n and exceeds it by less than the first."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def _round(value: Column, number: int, seed: int, radix: int) -> Column:
    return F.pmod(F.xxhash64(value.cast("long"), F.lit(seed * 1000 + number).cast("long")), F.lit(radix).cast("long"))


def feistel(x: Column, n: int, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """One pass of the network over the grid of n: a permutation of 0..a*b-1."""
    a, b = grid(n)
    left, right = F.pmod(x, F.lit(a).cast("long")), _div(x, a)
    for i in range(rounds):
        if i % 2 == 0:
            left = F.pmod(left + _round(right, i, seed, a), F.lit(a).cast("long"))
        else:
            right = F.pmod(right + _round(left, i, seed, b), F.lit(b).cast("long"))
    return left + right * F.lit(a).cast("long")


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def permute(x: Column, n: int, seed: int = 0) -> Column:
    """The permutation of 0..n-1. Fewer than a = sqrt(n) cells lie outside, so a walk ends after a steps; beyond a = 64 it stops after 65,
    which a walk outlasts with a chance below 65 ** -65, and then the row fails loudly."""
    steps = min(grid(n)[0], 64) + 1
    end = F.lit(n).cast("long")
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        feistel(x, n, seed),
        lambda at, _: F.when(at < end, at).otherwise(feistel(at, n, seed)),
    )
    first = feistel(x, n, seed)
    found = F.when(first < end, first).otherwise(walk)
    return F.when(found < end, found).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def place(row_number: Column, n: int, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """(shard, slot) of a global row number."""
    p = permute(row_number, n, seed)
    return F.pmod(p, F.lit(shards).cast("long")).cast("int"), _div(p, shards)


def number_rows(df: DataFrame, rows_per_range: int = 1_000_000, least_ranges: int = 256, block: int = 1 << 16) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` (long, from 0) and its count: rows stand in the order of the xxhash64 of all columns, then of the columns.

    Rows that are equal in all columns are counted before anything is shuffled and written out again at the end, in blocks of
    ``block``, so no number of copies meets in one task. The leading bits of the hash cut what differs into even ranges, a power of two of
    them. A row's number is its range's offset plus its place inside; only the counts of the ranges (a row for each) are
    gathered and broadcast.
    """
    n = df.count()
    bits = max(least_ranges, -(-n // rows_per_range) - 1).bit_length()
    kinds = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).withColumn("_hash", F.xxhash64(*df.columns))
    ranged = kinds.withColumn("_range", F.shiftrightunsigned("_hash", 64 - bits))
    offsets = ranged.groupBy("_range").agg(F.sum("_n").alias("_n"))
    offsets = offsets.selectExpr("_range", "sum(_n) over (order by _range rows between unbounded preceding and current row) - _n as _offset")
    keys = ", ".join(f"{c} asc nulls first" for c in ["_hash", *df.columns])
    inside = F.expr(f"sum(_n) over (partition by _range order by {keys} rows between unbounded preceding and current row) - _n")
    first = ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn("_first", F.col("_offset") + F.col("_inside"))
    first = first.select(*df.columns, "_first", "_n")
    few = first.where(F.col("_n") <= block)
    many = first.where(F.col("_n") > block).withColumn("_at", F.explode(F.expr(f"sequence(0L, _n - 1, {block}L)")))
    many = many.select(*df.columns, (F.col("_first") + F.col("_at")).alias("_first"), F.least(F.col("_n") - F.col("_at"), F.lit(block)).alias("_n"))
    every = few.unionByName(many.repartition(F.col("_first")))
    return every.withColumn("_k", F.explode(F.expr("sequence(0L, _n - 1)"))).withColumn("row_number", F.col("_first") + F.col("_k")).drop("_first", "_n", "_k"), n


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document; the law is ``rows``."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    numbered, n = number_rows(narrow)
    p = numbered.withColumn("_p", permute(F.col("row_number"), n, seed))
    shard = F.pmod(F.col("_p"), F.lit(shards).cast("long"))
    return p.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        _div(F.col("_p"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
