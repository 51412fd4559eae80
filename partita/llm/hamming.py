"""Bounded buckets in which all pairs of 64-bit fingerprints at a small Hamming distance meet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.llm.common import stored

#: Fingerprints that differ in at most three bits agree on one of four blocks.
RADIUS, BLOCKS, BITS = 3, 4, 16


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1))


def _rest(fp: Column, k: int) -> Column:
    """The 48 bits beside block k, moved together."""
    low = fp.bitwiseAND(F.lit((1 << (k * BITS)) - 1))
    high = F.shiftrightunsigned(fp, (k + 1) * BITS) if k < BLOCKS - 1 else F.lit(0).cast("long")
    return low.bitwiseOR(F.shiftleft(high, k * BITS))


def buckets(rows: DataFrame, limit: int = 64, most: int = 1024) -> DataFrame:
    """rows (with a long column fp) dealt to buckets (key, part_a, part_b): every two rows within RADIUS share one.

    Rows agree on a 16-bit block. A block value of over `limit` rows is split exactly: the 48 other bits differ in
    at most three places too, so they agree on one of four 12-bit blocks (28 bits in all). What still holds over
    `most` rows is dealt to shards of about `most` rows by a hash of the row, and each pair of shards is a bucket:
    no row is dropped and no bucket grows with the input. Null fingerprints take no part.
    """
    names = rows.columns
    fp = F.col("fp")
    block = F.explode(F.array(*[F.lit(k) for k in range(BLOCKS)]))
    pick = lambda k, of: F.element_at(F.array(*of), F.col(k) + 1)
    first = (
        rows.filter(fp.isNotNull())
        .select("*", block.alias("_k"))
        .withColumn("key", pick("_k", [_block(fp, k) for k in range(BLOCKS)]) * BLOCKS + F.col("_k"))
    )
    # written, so that Spark knows its size: where few values are full, as is usual, the joins need no shuffle
    full = stored(first.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit), "full-blocks")
    few = first.join(full, "key", "left_anti").select(*names, "key")
    finer = (
        first.join(full.select("key"), "key", "left_semi")
        .withColumn("_r", pick("_k", [_rest(fp, k) for k in range(BLOCKS)]))
        .select(*names, "key", "_r", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("_j"))
        .withColumn("_v", F.expr("shiftrightunsigned(_r, _j * 12)").bitwiseAND(F.lit(4095)))
        .withColumn("key", ((F.col("key") * 4 + F.col("_j")) * 4096 + F.col("_v")) + F.lit(1 << 40))
        .select(*names, "key")
    )
    packed = stored(finer.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > most), "full-finer-blocks")
    some = finer.join(packed, "key", "left_anti")
    shards = F.ceil(F.col("_n") / most).cast("int")
    many = (
        finer.join(packed, "key")
        .withColumn("_s", F.pmod(F.xxhash64(*names), shards).cast("int"))
        .select(*names, "key", "_s", F.explode(F.sequence(F.lit(0), shards - 1)).alias("_o"))
        .select(*names, "key", F.least("_s", "_o").alias("part_a"), F.greatest("_s", "_o").alias("part_b"))
    )
    alone = few.unionByName(some).withColumns({"part_a": F.lit(0), "part_b": F.lit(0)})
    return alone.unionByName(many)


def owned(key, differing: np.ndarray) -> np.ndarray:
    """Which pairs of buckets (key: one or one a pair), given by their differing bits, belong there: those that agree on no earlier block.

    Pairs share up to four blocks (and up to four finer ones within each); this leaves each pair one bucket.
    """
    d = differing.astype(np.uint64)
    key = np.broadcast_to(np.asarray(key, dtype=np.int64), d.shape)
    fine = key >= 1 << 40
    path = np.where(fine, (key - (1 << 40)) >> 12, key << 2)
    k, j = (path >> 2) % BLOCKS, path & 3
    mine = np.ones(len(d), dtype=bool)
    for b in range(BLOCKS - 1):
        mine &= (b >= k) | ((d >> np.uint64(b * BITS)) & np.uint64((1 << BITS) - 1) != 0)
    for block in range(BLOCKS):
        at = np.flatnonzero(fine & (k == block))
        low = d[at] & np.uint64((1 << (block * BITS)) - 1)
        high = d[at] >> np.uint64((block + 1) * BITS) if block < BLOCKS - 1 else np.zeros(len(at), dtype=np.uint64)
        rest = low | high << np.uint64(block * BITS)
        for b in range(3):
            mine[at] &= (b >= j[at]) | ((rest >> np.uint64(b * 12)) & np.uint64(4095) != 0)
    return mine
