"""Array expressions whose work grows with the array's length. Every expression that is used twice is bound once."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Elements that are summed in one go; sums of more are taken by blocks.
_BLOCK = 128


def bound(x: Column, f) -> Column:
    """f(x), where x is computed once however often f uses it (an expression in a lambda function is otherwise written out each time)."""
    return F.get(F.transform(F.array(x), f), 0)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)


def sums_before(values: Column) -> Column:
    """For each number of an array, the sum of those before it."""

    def of_blocks(blocks: Column) -> Column:
        return bound(F.transform(blocks, _total), lambda sums: F.flatten(F.transform(blocks, lambda b, k: inside(b, _total(F.slice(sums, 1, k))))))

    def inside(block: Column, base: Column) -> Column:
        return bound(base, lambda start: F.transform(block, lambda _, j: start + _total(F.slice(block, 1, j))))

    def cut(v: Column) -> Column:
        return bound(F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(_BLOCK)), lambda s: F.slice(v, s + 1, _BLOCK)), of_blocks)

    return bound(values.cast("array<bigint>"), cut)


def numbers_below(points: Column, queries: Column, inclusive: bool) -> Column:
    """For each of the sorted ``queries``, how many ``points`` are less (``inclusive``: or equal)."""
    is_point = 0 if inclusive else 1
    entry = lambda rank: lambda p: F.struct(p.cast("bigint").alias("at"), F.lit(rank).alias("rank"))
    merged = F.sort_array(F.concat(F.transform(points, entry(is_point)), F.transform(queries, entry(1 - is_point))))

    def count(m: Column) -> Column:
        before = sums_before(F.transform(m, lambda x: (x["rank"] == is_point).cast("bigint")))
        return bound(before, lambda c: F.array_compact(F.transform(m, lambda x, i: F.when(x["rank"] != is_point, F.get(c, i)))))

    return bound(merged, count)
