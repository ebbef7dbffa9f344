"""Ordered scans (previous value, running sums) whose tasks hold a piece of a key, however large the key.

A table longer than a piece is cut by range of (key, order): a sample gives the cut points, at most
``MOST_PIECES`` of them, and a row's piece is the number of its key's cut points that do not lie
after it. Rows are shuffled once, by (key, piece); only keys that a cut point falls into have more
than one piece. Windows work within a piece. What a piece leaves behind is one row of a small
table, over which a second window gives every piece its carry. Any orderable columns will do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

PIECE, CUT = "_piece", "_cut"
# Rows that one task may hold of one key; tables up to this length are not cut.
PIECE_ROWS = 1_000_000
MOST_PIECES, SAMPLES = 16_384, 16


def find_cuts(df: DataFrame, keys: list[str], order: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame | None:
    """``(*keys, _bounds)`` for the keys that cut points fall into; None for a table of one piece.

    The sample has about ``SAMPLES`` rows a piece, sorted in one task; the cut points come to the
    driver, so that every use of the table sees the same ones. They balance the work only: results
    are the same for any.
    """
    total = df.count()
    pieces = min(MOST_PIECES, -(-total // piece_rows))
    if pieces < 2:
        return None
    picked = df.select(*keys, *order).sample(min(1.0, 1.2 * SAMPLES * pieces / total), seed=0)
    rows = picked.agg(F.sort_array(F.collect_list(F.struct(*keys, *order))).alias("all"))
    at = F.transform(F.sequence(F.lit(1), F.lit(pieces - 1)), lambda i: (i * F.size("all") / pieces).cast("int"))
    points = rows.filter(F.size("all") > 0).select(F.explode(F.array_distinct(F.transform(at, lambda i: F.get("all", i)))).alias("c"))
    found = [[r.c[k] for k in keys] + [tuple(r.c[k] for k in order)] for r in points.collect()]
    if not found:
        return None
    fields = {f.name: f.dataType for f in df.schema.fields}
    position = StructType([StructField(k, fields[k]) for k in order])
    schema = StructType([*[StructField(k, fields[k]) for k in keys], StructField("_bounds", ArrayType(position))])
    bounds: dict[tuple, list] = {}
    for *key, point in found:  # in order already
        bounds.setdefault(tuple(key), []).append(point)
    return df.sparkSession.createDataFrame([(*key, points) for key, points in bounds.items()], schema)


def with_pieces(df: DataFrame, cuts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``_piece``, which rises with the order within a key, and ``_cut``: whether the key has several.

    The table of cut points is broadcast: it has at most ``MOST_PIECES`` of them.
    """
    if keys:
        bounded = join_same(df, F.broadcast(cuts), keys, "left")
    else:
        bounded = df.withColumn("_bounds", cuts.select("_bounds").scalar())
    position = F.struct(*order)
    # the first bound after the row, by binary search
    start = F.struct(F.lit(0).alias("lo"), F.size("_bounds").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s.lo + s.hi, 1)
        passed = (s.lo < s.hi) & (F.get("_bounds", mid) <= position)
        return F.struct(F.when(passed, mid + 1).otherwise(s.lo).alias("lo"), F.when(passed, s.hi).otherwise(F.greatest(s.lo, mid)).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(MOST_PIECES.bit_length()))
    piece = F.aggregate(steps, start, halve, lambda s: s.lo)
    return bounded.withColumn(PIECE, F.when(F.col("_bounds").isNull(), 0).otherwise(piece)).withColumn(
        CUT, F.col("_bounds").isNotNull()).drop("_bounds")


def by_pieces(df: DataFrame, keys: list[str], order: list[str], plain: Callable[[DataFrame], DataFrame],
              pieced: Callable[[DataFrame], DataFrame], cuts: DataFrame | None) -> DataFrame:
    """``plain`` for a table that needs no cut, else ``pieced`` on rows with ``_piece`` and ``_cut``."""
    if cuts is None:
        return plain(df)
    return pieced(with_pieces(df, cuts, keys, order)).drop(PIECE, CUT)


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(renamed, match, how).drop(*[f"_r_{c}" for c in on])


def with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what their piece takes over; ``carry`` has a row a piece of a key that is cut, twice the cut points at most."""
    return join_same(rows, F.broadcast(carry), [*keys, PIECE], "left")


def running(keys: Sequence[str], order: Sequence[str]) -> Window:
    return (Window.partitionBy(*keys).orderBy(*order)
                  .rowsBetween(Window.unboundedPreceding, 0))


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
                 piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Inclusive running sums along ``order`` within ``keys`` (no keys: over the whole table)."""
    cuts = find_cuts(df, keys, order, piece_rows)
    if cuts is None:
        return df.withColumns({name: F.sum(value).over(running(keys, order)) for name, value in sums.items()})
    rows = with_pieces(df, cuts, keys, order)
    local = rows.withColumns({name: F.sum(value).over(running([*keys, PIECE], order)) for name, value in sums.items()})
    totals = rows.filter(CUT).groupBy(*keys, PIECE).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, PIECE, *[F.sum(name).over(earlier).alias(f"_c_{name}") for name in sums])
    return with_carry(local, carry, keys).withColumns(
        {name: added(F.col(name), F.col(f"_c_{name}")) for name in sums}).drop(PIECE, CUT, *[f"_c_{name}" for name in sums])


def added(one: Column, other: Column) -> Column:
    """Sum that leaves out a missing side, as ``sum`` does."""
    return F.coalesce(one + other, one, other)
