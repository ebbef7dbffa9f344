"""Array, map and score functions built on higher-order expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from wordtrail.functions.hashing import _col


def let(value: Column, body) -> Column:
    """Bind a value once so that a lambda does not evaluate it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted_items(items: Column | str) -> Column:
    """Distinct items as ``array<struct<item, n, first>>``, ``first`` being the 0-based place of the
    first; null for an empty list. One sort of the list, linear otherwise."""
    def runs(ordered: Column) -> Column:
        item = lambda i: F.get(ordered, i)["item"]
        begins = lambda i: (i == 0) | ~item(i).eqNullSafe(item(i - 1))

        def one(starts: Column) -> Column:
            return F.transform(starts, lambda start, j: F.struct(
                item(start).alias("item"),
                (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - start).cast("bigint").alias("n"),
                F.get(ordered, start)["place"].alias("first")))

        return let(F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), begins), one)

    items = _col(items)
    placed = F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("place")))
    return F.when(F.size(items) > 0, let(F.array_sort(placed), runs))


def item_counts(items: Column | str) -> Column:
    """Distinct items as ``array<struct<item, n>>``; null for an empty list. For items alone, without their
    places, Spark has a sort of its own, which costs a fraction of one by ``array_sort``'s comparison."""
    def runs(ordered: Column) -> Column:
        begins = lambda i: (i == 0) | ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1))

        def one(starts: Column) -> Column:
            return F.transform(starts, lambda start, j: F.struct(
                F.get(ordered, start).alias("item"),
                (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - start).cast("bigint").alias("n")))

        return let(F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), begins), one)

    items = _col(items)
    return let(items, lambda whole: F.when(F.size(whole) > 0, let(F.sort_array(whole), runs)))


def sum_columns(*columns: Column | str) -> Column:
    """Sum of any number of columns."""
    return reduce(add, [_col(c) for c in columns])


def best_position(values: Column | str) -> Column:
    """0-based position of the largest value; the first one wins ties, all-null gives null."""
    values = _col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def best_label(labels: Column | str, values: Column | str) -> Column:
    """The label standing at the position of the largest value."""
    return F.get(_col(labels), best_position(values))


def add_arrays(*arrays: Column | str) -> Column:
    """Element-wise sum."""
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [_col(a) for a in arrays])


def drop_zeros(values: Column | str) -> Column:
    return F.filter(_col(values), lambda v: v != 0)


def ascending_pairs(labels: Column | str) -> Column:
    """All pairs ``[a, b]`` of a short label list in ascending order (one row's votes)."""
    def pairs(ordered: Column) -> Column:
        def with_later(x: Column, i: Column) -> Column:
            later = F.slice(ordered, i + 2, F.greatest(F.size(ordered) - i - 1, F.lit(0)))
            return F.transform(later, lambda y: F.array(x, y))
        return F.flatten(F.transform(ordered, with_later))

    return let(F.sort_array(_col(labels)), pairs)


def first_if_repeated(values: Column | str) -> Column:
    """First element when it occurs again, otherwise the last one."""
    values = _col(values)
    first = F.get(values, F.lit(0))
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.array_contains(rest, first), first).otherwise(F.try_element_at(values, F.lit(-1)))


def first_key_except(metadata: Column | str, skipped: list[str]) -> Column:
    """First key of a map that is not in the skip list."""
    keys = F.filter(F.map_keys(_col(metadata)), lambda k: ~k.isin(skipped))
    return F.get(keys, F.lit(0))


def value_counts(values: Column) -> Column:
    """``array<struct<n, first, label>>`` of the distinct non-null values of one row's array."""
    def counts(seen: Column) -> Column:
        return F.transform(
            F.array_distinct(seen),
            lambda v: F.struct(F.size(F.filter(seen, lambda w: w == v)).alias("n"),
                               F.array_position(seen, v).alias("first"),
                               v.alias("label")))

    return let(F.array_compact(values), counts)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0.0 when either vector is all zeros."""
    a, b = _col(a), _col(b)
    size = norm(a) * norm(b)
    return F.when(size.isNotNull(), F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0)))


def unit_vector(a: Column | str) -> Column:
    """Vector scaled to length one; an all-zero vector stays as it is."""
    a = _col(a)
    return let(norm(a), lambda size: F.transform(
        a, lambda x: F.coalesce(F.try_divide(x.cast("double"), size), F.lit(0.0))))


def grade_from_fraction(score: Column | str, mode: int = 1) -> Column:
    """Scaled score 0..1 to a grade 1..6.

    1: ``5 * score + 1`` rounded half to even and clamped; 2: upper limits 0.2, 0.4 .. 1.0;
    3: nearest of 0.0, 0.2 .. 1.0 by midpoints.
    """
    score = _col(score)
    if mode == 1:
        grade = 5 * score + 1
        return (F.when(grade <= 1, 1).when(grade >= 6, 6).otherwise(F.bround(grade, 0))).cast("int")
    rounded = F.bround(score, 1)
    # Class limits.
    if mode == 2:
        limits = [0.2, 0.4, 0.6, 0.8, 1.0]
        tests = [rounded < limit for limit in limits]
    else:
        steps = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
        tests = [rounded <= (low + high) / 2 for low, high in zip(steps, steps[1:])]
    grade = F.when(score.isNull(), None)
    for number, test in enumerate(tests, start=1):
        grade = grade.when(test, number)
    return grade.otherwise(6).cast("int")
