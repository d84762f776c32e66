"""A Bloom screen over the seen table: no false negatives, few false positives, little space.

The sketch is a table of fixed-size bit blocks. A key's bits all lie in one block, so a probe
is one join per key, and blocks can be built, merged and stored like any rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The block of `bitmap_construct_agg`.
BLOCK_BITS = 32_768
# Keys are spread over blocks unevenly; this share of extra bits keeps the set error rate.
HEADROOM = 1.1


@dataclass(frozen=True)
class Shape:
    """Size of a sketch for a number of keys and a false positive rate."""

    capacity: int = 1_000_000
    error_rate: float = 0.001

    @property
    def blocks(self) -> int:
        bits = -self.capacity * math.log(self.error_rate) / math.log(2) ** 2
        return max(1, math.ceil(bits * HEADROOM / BLOCK_BITS))

    @property
    def hashes(self) -> int:
        return max(1, round(-math.log2(self.error_rate)))


def build_sketch(keys: DataFrame, shape: Shape, key: str = "url_key") -> DataFrame:
    """(bucket, bits) for the keys; a repeated key sets the same bits again."""
    placed = _place(keys.select(key), shape, key)
    return (
        placed.select("bucket", F.explode("positions").alias("position"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("position").alias("bits"))
    )


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """One sketch that holds the keys of all; they must have the same shape."""
    rows = sketches[0]
    for sketch in sketches[1:]:
        rows = rows.unionByName(sketch)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def might_be_seen(
    keys: DataFrame, sketch: DataFrame, shape: Shape, key: str = "url_key"
) -> DataFrame:
    """The distinct keys with `might_be_seen`; false means certainly not in the sketch."""
    placed = _place(keys.select(key).distinct(), shape, key)
    hit = F.coalesce(F.forall("positions", lambda p: _bit(F.col("bits"), p)), F.lit(False))
    return placed.join(sketch, "bucket", "left").select(
        key, (F.col("bits").isNotNull() & hit).alias("might_be_seen")
    )


def _place(keys: DataFrame, shape: Shape, key: str) -> DataFrame:
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(shape.blocks))
    start = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(BLOCK_BITS))
    # An odd step reaches every position of a block whose size is a power of two.
    step = F.pmod(F.xxhash64(F.col(key), F.lit(2)), F.lit(BLOCK_BITS // 2)) * 2 + 1
    rounds = F.sequence(F.lit(0), F.lit(shape.hashes - 1))
    return (
        keys.withColumn("bucket", bucket)
        .withColumn("_start", start)
        .withColumn("_step", step)
        .withColumn(
            "positions",
            F.transform(rounds, lambda n: (F.col("_start") + n * F.col("_step")) % BLOCK_BITS),
        )
        .drop("_start", "_step")
    )


def _bit(bits: Column, position: Column) -> Column:
    byte = F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.getbit(number, (position % 8).cast("int")) == 1
