"""Range shards that depend on the rows alone: not on partitions, sessions or a random sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys drawn for each shard (about); the shards' sizes then vary by some 1 / sqrt(PER_SHARD).
PER_SHARD = 64
#: Bytes of rows in a shard while there are few, how many shards that is for at most, and the bytes of one beyond.
SMALL_BYTES, SMALL_SHARDS, LARGE_BYTES = 16 << 20, 1024, 4 << 30
#: Bounds told apart by one comparison after another; a shard is found in two such steps.
_STEP = 256


def shard_count(n_bytes: int) -> int:
    return max(1, min(SMALL_SHARDS, -(-n_bytes // SMALL_BYTES)), -(-n_bytes // LARGE_BYTES))


def range_bounds(keys: DataFrame, rows: int, shards: int) -> list[tuple[int, int]]:
    """Ascending bounds (the first keys of shards 1 and up) from the keys of `keys` (two long columns, none null) whose hash is low.

    What is drawn depends on the keys alone and is bounded by PER_SHARD for each shard, about; equal keys, which no
    bound can part, count once.
    """
    if shards < 2 or not rows:
        return []
    a, b = keys.columns
    part = min(1.0, PER_SHARD * shards / rows)
    low = F.pmod(F.xxhash64(a, b), F.lit(1 << 30)) <= int(part * (1 << 30))
    drawn = sorted((r[0], r[1]) for r in keys.where(low).distinct().collect())
    return sorted({drawn[i * len(drawn) // shards] for i in range(1, shards)}) if drawn else []


def shard_of(first: Column, second: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many bounds are at or below the key: its shard."""
    if not bounds:
        return F.lit(0)
    long = lambda values: F.lit(list(values)).cast("array<bigint>")

    def below(pairs: Column) -> Column:
        return F.size(F.filter(pairs, lambda x: (x["a"] < first) | (x["a"].eqNullSafe(first) & (x["b"] <= second))))

    def pairs(part: list[tuple[int, int]]) -> Column:
        return F.arrays_zip(long(x for x, _ in part).alias("a"), long(x for _, x in part).alias("b"))

    if len(bounds) <= _STEP:
        return below(pairs(bounds))
    heads = below(pairs(bounds[::_STEP]))
    blocks = F.array(*[pairs(bounds[i : i + _STEP]) for i in range(0, len(bounds), _STEP)])
    return F.when(heads == 0, 0).otherwise((heads - 1) * _STEP + below(F.get(blocks, heads - 1)))
