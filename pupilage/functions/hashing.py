"""Deterministic hashes: SHA-256, unit interval, FNV-1a buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of 64-bit FNV-1a: the offset basis in two 32-bit limbs and the
# low part of the prime 2^40 + 435.
FNV_BASIS_HIGH = 0xCBF29CE4
FNV_BASIS_LOW = 0x84222325
FNV_PRIME_LOW = 435
LIMB = 0xFFFFFFFF


def unit_interval(text: Column) -> Column:
    """Uniform double in [0, 1): the top 53 bits of the text's SHA-256."""
    top = F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("bigint")
    return F.shiftright(top, 3).cast("double") / F.lit(float(1 << 53))


def split_key(group: Column, content_hash: Column) -> Column:
    """Rows with one key always land on the same side of a split or fold."""
    return F.coalesce(F.concat(F.lit("group:"), group), F.concat(F.lit("content:"), content_hash))


def is_holdout(key: Column, seed: str, fraction: float) -> Column:
    return unit_interval(F.concat(F.lit(seed + "\0"), key)) < F.lit(float(fraction))


def fold(key: Column, seed: str, folds: Column | int) -> Column:
    count = F.lit(folds) if isinstance(folds, int) else folds
    position = F.floor(unit_interval(F.concat(F.lit(f"cv\0{seed}\0"), key)) * count)
    return F.least(count - 1, position).cast("int")


def fnv_bucket(token: Column, dimensions: int) -> Column:
    """FNV-1a of the UTF-8 bytes modulo ``dimensions``, as plain column maths.

    The 64-bit state is kept in two 32-bit limbs, because a 64-bit product
    overflows under ANSI arithmetic.
    """
    pairs = F.regexp_extract_all(F.hex(F.encode(token, "utf-8")), F.lit("(..)"), F.lit(1))

    def absorb(state: Column, pair: Column) -> Column:
        x = state["lo"].bitwiseXOR(F.conv(pair, 16, 10).cast("bigint"))
        product = x * FNV_PRIME_LOW
        high = state["hi"] * FNV_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(LIMB)).alias("hi"), product.bitwiseAND(F.lit(LIMB)).alias("lo"))

    def reduce(state: Column) -> Column:
        return ((state["hi"] % dimensions) * ((1 << 32) % dimensions) + state["lo"]) % dimensions

    start = F.struct(F.lit(FNV_BASIS_HIGH).cast("bigint").alias("hi"), F.lit(FNV_BASIS_LOW).cast("bigint").alias("lo"))
    return F.aggregate(pairs, start, absorb, reduce)
