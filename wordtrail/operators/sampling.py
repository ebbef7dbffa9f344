"""Samples, splits and class balancing by key hash.

A row is kept when its key's unit hash is below the wanted fraction, so a sample does not change
when the table is repartitioned, retried or re-read. Class sizes come from one aggregate that is
read as a scalar subquery: no class is collected, no join is needed and the rows are scanned once
more only to be filtered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from wordtrail.functions.hashing import hash32, unit_hash
from wordtrail.session import cut_lineage


def _unit(key: str, seed: str | None) -> Column:
    """Unit hash of the key; another seed gives an independent draw."""
    return unit_hash(key) if seed is None else unit_hash(F.col(key), F.lit(seed))


def bernoulli(df: DataFrame, key: str, fraction: float, seed: str | None = None) -> DataFrame:
    return df.filter(_unit(key, seed) < fraction)


def with_split(df: DataFrame, key: str, train: float = 0.75, seed: str | None = None) -> DataFrame:
    """Add ``split`` = train or test."""
    return df.withColumn("split", F.when(_unit(key, seed) < train, "train").otherwise("test"))


def with_batch(df: DataFrame, key: str, batches: int = 10, seed: str | None = None) -> DataFrame:
    """Add a batch number; all batches are processed by one job."""
    return df.withColumn("batch", F.floor(_unit(key, seed) * batches).cast("int"))


def class_sizes(df: DataFrame, label: str, classes: list) -> Column:
    """Array of row counts in the order of ``classes``, as a scalar subquery."""
    counts = [F.count_if(F.col(label) == c) for c in classes]
    return df.agg(F.array(*counts).alias("sizes")).scalar()


def _size(sizes: Column, position: int) -> Column:
    return F.get(sizes, F.lit(position)).cast("double")


def balanced_pair(df: DataFrame, key: str, label: str, pair: tuple,
                  seed: str | None = None) -> DataFrame:
    """Both classes, the larger one cut to about the size of the smaller."""
    sizes = class_sizes(df, label, list(pair))
    a, b = _size(sizes, 0), _size(sizes, 1)
    keep = F.when(F.col(label) == pair[0], F.try_divide(b, a)).otherwise(F.try_divide(a, b))
    return df.filter(F.col(label).isin(*pair) & (_unit(key, seed) < keep))


def target_against_far(df: DataFrame, key: str, label: str, target: int, classes: list[int],
                       coefficient: float = 1.0, seed: str | None = None) -> DataFrame:
    """Target class against all classes more than one step away, the larger side sampled to
    ``coefficient`` times the smaller; adds ``score_<target>`` (target or 0)."""
    far = [c for c in classes if abs(c - target) > 1]
    sizes = df.agg(F.array(F.count_if(F.col(label) == target),
                           F.count_if(F.col(label).isin(far))).alias("sizes")).scalar()
    t, f = _size(sizes, 0), _size(sizes, 1)
    ratio = F.try_divide(F.least(t, f), F.greatest(t, f))
    fraction = F.when(ratio * coefficient < 1, ratio * coefficient).otherwise(ratio)
    is_target = F.col(label) == target
    larger = F.when(t > f, is_target).otherwise(~is_target)
    return (df.filter(F.col(label).isin([target, *far]) & (~larger | (_unit(key, seed) < fraction)))
              .withColumn(f"score_{target}", F.when(is_target, F.col(label)).otherwise(0)))


def loose_pair(df: DataFrame, key: str, label: str, pair: tuple, tolerated: float = 3.0,
               factor: float = 2.2, seed: str | None = None) -> DataFrame:
    """Both classes; one more than ``tolerated`` times the other is cut to ``factor`` times it."""
    sizes = class_sizes(df, label, list(pair))
    a, b = _size(sizes, 0), _size(sizes, 1)

    def keep(own: Column, other: Column) -> Column:
        return F.when(own > tolerated * other, factor * other / own).otherwise(1.0)

    fraction = F.when(F.col(label) == pair[0], keep(a, b)).otherwise(keep(b, a))
    return df.filter(F.col(label).isin(*pair) & (_unit(key, seed) < fraction))


def binary_against_rest(df: DataFrame, key: str, label: str, target, classes: list,
                        seed: str | None = None) -> DataFrame:
    """All target rows; every other class cut to ``int(target rows / (classes - 1))``.
    Adds ``binary_score`` (target or 0)."""
    sizes = class_sizes(df, label, classes)
    quota = F.floor(_size(sizes, classes.index(target)) / (len(classes) - 1)).cast("double")
    fraction = F.lit(0.0)
    for position, c in enumerate(classes):
        own = _size(sizes, position)
        part = F.lit(1.0) if c == target else F.try_divide(F.least(own, quota), own)
        fraction = F.when(F.col(label) == c, part).otherwise(fraction)
    return (df.filter(_unit(key, seed) < fraction)
              .withColumn("binary_score", F.when(F.col(label) == target, F.col(label))
                          .otherwise(F.lit(0).cast(df.schema[label].dataType))))


def uniform_sets(df: DataFrame, key: str, label: str, target, classes: list,
                 fraction: float, seed: str | None = None) -> DataFrame:
    """Sample sets of similar class sizes, told apart by ``sample_id``.

    Every other class is cut into as many buckets as the sampled target fits into it; the largest
    class gives one set per bucket. A class with fewer buckets lends a bucket again, chosen by
    hash. Each set holds all target rows. Which set takes which bucket is a table of its own that
    the rows are joined with; only the target rows are repeated for all sets.
    """
    others = [c for c in classes if c != target]
    is_target = F.col(label) == target
    wanted = df.agg(F.count_if(is_target & (_unit(key, seed) < fraction)).cast("double").alias("n")).scalar()
    fitting = F.floor(F.try_divide(F.col("_n").cast("double"), wanted))
    rest = df.filter(F.col(label).isin(others))
    owned = rest.groupBy(label).agg(F.count("*").alias("_n")).select(
        label, F.coalesce(F.greatest(fitting, F.lit(1)), F.lit(1)).cast("int").alias("_own"))
    every = F.sequence(F.lit(0), owned.agg(F.coalesce(F.max("_own"), F.lit(1)).alias("sets")).scalar() - 1)
    lent = F.floor(unit_hash(F.col(label), F.col("sample_id")) * F.col("_own")).cast("int")
    takes = owned.withColumn("sample_id", F.explode(every)).select(
        label, "sample_id", F.when(F.col("sample_id") < F.col("_own"), F.col("sample_id")).otherwise(lent).alias("_bucket"))
    placed = rest.join(F.broadcast(owned), label).withColumn(  # a row a class
        "_bucket", F.floor(_unit(key, seed) * F.col("_own")).cast("int"))
    taken = placed.join(takes, [label, "_bucket"]).select(*df.columns, "sample_id")
    return taken.unionByName(df.filter(is_target).withColumn("sample_id", F.explode(every)))


def exact_samples(df: DataFrame, key: str, label: str, wanted: Callable[[DataFrame], DataFrame], seed: str | None = None,
                  bits: int = 16) -> DataFrame:
    """As many rows of each class as ``wanted`` says, those of the smallest key hashes.

    ``wanted`` makes ``(label, n, wanted)`` of the class sizes ``(label, n)``; a class left out has
    no row in the result, one with fewer rows than wanted keeps all. A histogram over the first
    ``bits`` bits of the hash finds the prefix in which each class reaches its number; only the rows
    of that prefix, one in ``2 ** bits``, are ranked. Rows that share a key count as one place each,
    and stay or go by their order among equal keys only if that is where the number is reached.
    """
    h = hash32(key) if seed is None else hash32(F.col(key), F.lit(seed))
    rows = df.withColumns({"_hash": h, "_prefix": F.shiftrightunsigned(h, 32 - bits).cast("int")}).filter(F.col(label).isNotNull())
    sizes = rows.groupBy(label, "_prefix").agg(F.count("*").alias("_n"))
    sums = cut_lineage(sizes)  # classes times prefixes at most
    asked = wanted(sums.groupBy(label).agg(F.sum("_n").alias("n")))
    so_far = Window.partitionBy(label).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    reached = sums.withColumn("_sum", F.sum("_n").over(so_far)).join(asked, label)
    edge = cut_lineage(reached.groupBy(label).agg(
        F.min(F.when(F.col("_sum") >= F.col("wanted"), F.struct("_prefix", (F.col("wanted") - F.col("_sum") + F.col("_n")).alias("need")))).alias("e"),
        F.max("wanted").alias("wanted")).select(label, F.col("e._prefix").alias("_edge"), F.col("e.need").alias("_need"), "wanted"))
    near = rows.join(F.broadcast(edge), label)  # a row a class
    whole = near.filter((F.col("wanted") > 0) & (F.col("_edge").isNull() | (F.col("_prefix") < F.col("_edge"))))
    order = Window.partitionBy(label).orderBy("_hash", key)
    part = near.filter(F.col("_prefix") == F.col("_edge")).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.col("_need"))
    return whole.select(df.columns).unionByName(part.select(df.columns))


def exact_pair(df: DataFrame, key: str, label: str, pair: tuple, seed: str | None = None) -> DataFrame:
    """Both classes, the larger one cut to exactly the size of the smaller; nothing if one is missing."""
    both = df.filter(F.col(label).isin(*pair))
    least = lambda sizes: sizes.withColumn("wanted", F.when(F.count("*").over(Window.partitionBy()) < 2, 0).otherwise(F.min("n").over(Window.partitionBy())))  # noqa: E731  two rows
    return exact_samples(both, key, label, least, seed)


def exact_against_rest(df: DataFrame, key: str, label: str, target, seed: str | None = None) -> DataFrame:
    """All target rows; of every other class exactly ``int(target rows / (classes - 1))``, or all it has.
    Adds ``binary_score`` (target or 0)."""
    def quota(sizes: DataFrame) -> DataFrame:
        whole = sizes.agg(F.struct(F.max(F.when(F.col(label) == target, F.col("n"))).alias("target"), F.count("*").alias("classes")).alias("w")).scalar()
        share = F.floor(F.coalesce(whole.target, F.lit(0)) / F.greatest(whole.classes - 1, F.lit(1)))
        return sizes.withColumn("wanted", F.when(F.col(label) == target, F.col("n")).otherwise(F.least(F.col("n"), share)))

    return exact_samples(df, key, label, quota, seed).withColumn("binary_score", F.when(F.col(label) == target, F.col(label)).otherwise(F.lit(0).cast(df.schema[label].dataType)))


def class_split_counts(df: DataFrame, label: str, splits: list[str]) -> DataFrame:
    """Class distribution of all splits side by side, in one aggregate."""
    return df.groupBy(label).agg(*[F.count_if(F.col("split") == s).alias(f"count_{s}") for s in splits])
