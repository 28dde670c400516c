"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_owner(key: Column | str, workers: int) -> Column:
    """The worker of a key: its absolute value modulo their number."""
    return F.abs(key) % workers


def tuple_owner(workers: int, *parts: Column | str) -> Column:
    """The worker of a tuple of keys, by hash. Placement only."""
    return F.pmod(F.xxhash64(*parts), F.lit(workers))


def flag(bit: Column | int) -> Column:
    """A number with one bit set."""
    return F.call_function("shiftleft", F.lit(1), bit if isinstance(bit, Column) else F.lit(bit))


def has_flag(flags: Column | str, bit: int) -> Column:
    return (F.col(flags) if isinstance(flags, str) else flags).bitwiseAND(F.lit(1 << bit)) != 0


def without_flag(flags: Column | str, bit: int) -> Column:
    return (F.col(flags) if isinstance(flags, str) else flags).bitwiseAND(F.lit(~(1 << bit)))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that follows from seed and parts alone: the first 32 bits of their MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))).cast("double")


def sampled(rate: float, seed: int, *parts: Column | str) -> Column:
    """Whether a row belongs to a uniform sample of ``rate``; the same rows whenever it is computed."""
    return uniform(seed, *parts) < rate
