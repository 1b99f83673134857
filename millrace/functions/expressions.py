"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    """0 to buckets - 1 by the md5 of seed and key: the same draw in any engine, for splits and sampling."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets


def clip(x: Column, low: float, high: float) -> Column:
    """x within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b; a where b is zero."""
    return a / F.when(b == 0, 1).otherwise(b)


def mapped(x: Column, values: dict) -> Column:
    """The value for x; null where there is none."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def sigmoid(x: Column, bound: float = 35.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -bound, bound)))


def softmax(xs: Column) -> Column:
    shifted = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
