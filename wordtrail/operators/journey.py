"""Event streams to journeys: runs of equal pages, one ordered page list per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wordtrail.operators.scan import CUT, PIECE, added, by_pieces, find_cuts, join_same, running, with_carry

# Fixed value: what stands before the first page of a user.
START = "started"
# A journey longer than this is stored as several numbered rows.
PART_SIZE = 10_000


def page_popularity(events: DataFrame, user: str = "user_id", page: str = "page") -> DataFrame:
    """Views and distinct users per page. Users are first made distinct per page, spread over
    both columns, so a page with a third of all views is no single group."""
    per_user = events.groupBy(page, user).agg(F.count("*").alias("views"))
    return per_user.groupBy(page).agg(F.sum("views").alias("views"), F.count(user).alias("users"))


def mark_runs(events: DataFrame, user: str, page: str, order: list[str], cuts: DataFrame | None) -> DataFrame:
    """Events with ``previous_page`` ('started' first), ``indicator`` (page changed) and
    ``run`` (number of changes so far: 1, 2, ...). ``cuts`` are those of ``find_cuts`` for (user, order)."""

    def plain(df: DataFrame) -> DataFrame:
        by_user = Window.partitionBy(user).orderBy(*order)
        return (df.withColumn("previous_page", F.lag(page, 1, START).over(by_user))
                  .withColumn("indicator", _changed(F.col(page), F.col("previous_page")))
                  .withColumn("run", F.sum("indicator").over(running([user], order))))

    def pieced(df: DataFrame) -> DataFrame:
        local = _local_runs(df, user, page, order)
        first_page = F.when(F.col("_before").isNull(), F.lit(START)).otherwise(F.col("_before.page"))
        before = F.when(F.col("_row") == 1, first_page).otherwise(F.col("_lag"))
        return (with_carry(local, _run_carry(local, user, page, order), [user])
                .withColumn("previous_page", before)
                .withColumn("indicator", _changed(F.col(page), F.col("previous_page")))
                .withColumn("run", F.coalesce("_base", "_opens") + F.col("_local"))
                .drop("_row", "_lag", "_local", "_opens", "_before", "_base"))

    return by_pieces(events, [user], order, plain, pieced, cuts)


def run_times(marked: DataFrame, user: str, time: str, order: list[str], cuts: DataFrame | None) -> DataFrame:
    """Marked events with the running time inside their run (``run_time``)."""

    def plain(df: DataFrame) -> DataFrame:
        return df.withColumn("run_time", F.sum(time).over(running([user, "run"], order)))

    def pieced(df: DataFrame) -> DataFrame:
        local = df.withColumn("run_time", F.sum(time).over(running([user, PIECE, "run"], order)))
        # only a piece's first run can have begun earlier: in pieces that end with the same run
        edges = local.filter(CUT).groupBy(user, PIECE).agg(
            F.min("run").alias("_first"), F.max_by(F.struct("run", "run_time"), F.struct(*order)).alias("last"))
        ended = edges.withColumn("tail", F.sum("last.run_time").over(
            Window.partitionBy(user, "last.run").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, 0)))
        before = Window.partitionBy(user).orderBy(PIECE)
        carry = ended.select(user, PIECE, "_first", F.when(
            F.lag("last.run").over(before) == F.col("_first"), F.lag("tail").over(before)).alias("_carry"))
        time_so_far = F.when(F.col("run") == F.col("_first"), added(F.col("run_time"), F.col("_carry"))).otherwise(F.col("run_time"))
        return with_carry(local, carry, [user]).withColumn("run_time", time_so_far).drop("_first", "_carry")

    return by_pieces(marked, [user], order, plain, pieced, cuts)


def collapse_runs(events: DataFrame, user: str, page: str, time: str, converted: Column,
                  order: list[str], cuts: DataFrame | None) -> DataFrame:
    """One row per run: ``(user, run, page, run_time, converted)``.

    Of a table that needs no cut, window and grouping share the shuffle by user. Else runs are
    collapsed within ``(user, piece)`` first; parts of a run that a cut point falls into are added
    up at the end.
    """
    events = events.select(user, F.col(page).alias("page"), F.col(time).alias("time_spent"),
                           converted.cast("int").alias("converted"), *order)

    def per_run(df: DataFrame, *keys: str, time: str = "time_spent") -> DataFrame:
        return df.groupBy(user, *keys).agg(F.max("page").alias("page"), F.sum(time).alias("run_time"),
                                           F.max("converted").alias("converted"))

    def plain(df: DataFrame) -> DataFrame:
        return per_run(mark_runs(df, user, "page", order, None), "run")

    def pieced(df: DataFrame) -> DataFrame:
        local = _local_runs(df, user, "page", order)
        parts = with_carry(per_run(local, PIECE, "_local", "_opens"), _run_carry(local, user, "page", order), [user])
        return per_run(parts.withColumn("run", F.coalesce("_base", "_opens") + F.col("_local")), "run", time="run_time")

    return by_pieces(events, [user], order, plain, pieced, cuts)


def journeys(runs: DataFrame, user: str, cuts: DataFrame | None, part_size: int = PART_SIZE) -> DataFrame:
    """Ordered page and time lists per user, with ``converted`` over all the user's runs.

    ``part`` is 0 for all but very long journeys, which go on in parts 1, 2, ... of at most
    ``part_size`` runs each, so no list outgrows a task and no run is dropped.
    """
    part = F.floor((F.col("run") - 1) / part_size).cast("int").alias("part")
    parts = runs.groupBy(user, part).agg(
        F.array_sort(F.collect_list(F.struct("run", "page", "run_time"))).alias("steps"),
        F.max("converted").alias("converted"))
    columns = [F.col(user), F.col("part"), F.col("steps.page").alias("pages"),
               F.col("steps.run_time").alias("times")]
    if cuts is None:
        return parts.select(*columns, F.max("converted").over(Window.partitionBy(user)).alias("converted"))
    # users that are cut may have lists too long to sort together; their flags are a few rows
    of_cut = join_same(runs.select(user, "converted"), F.broadcast(cuts.select(user)), [user])
    flags = of_cut.groupBy(user).agg(F.max("converted").alias("_ever")).withColumn(CUT, F.lit(True))
    flagged = join_same(parts, F.broadcast(flags), [user], "left")
    ever = F.max("converted").over(Window.partitionBy(user)).alias("converted")
    return (flagged.filter(F.col(CUT).isNull()).select(*columns, ever)
            .unionByName(flagged.filter(CUT).select(*columns, F.col("_ever").alias("converted"))))


def user_journeys(events: DataFrame, user: str, page: str, time: str, converted: Column,
                  order: list[str], part_size: int = PART_SIZE) -> DataFrame:
    """Events to journeys in one go; the cut points are looked up once."""
    cuts = find_cuts(events, [user], order)
    runs = collapse_runs(events, user, page, time, converted, order, cuts)
    return journeys(runs, user, cuts, part_size)


def list_positions(runs: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Runs with the ``part`` and ``position`` they have in the lists of :func:`journeys`.

    The list walked so far is that list up to the position; no row repeats it.
    """
    at = F.col("run") - 1
    return runs.withColumns({"part": F.floor(at / part_size).cast("int"), "position": (at % part_size + 1).cast("int")})


def running_lists(runs: DataFrame, user: str) -> DataFrame:
    """Runs with the list of pages and times walked so far, of a few users: the result grows with
    the square of the list length. For whole tables take :func:`list_positions`."""
    so_far = running([user], ["run"])
    return runs.withColumns({"pages_so_far": F.collect_list("page").over(so_far),
                             "times_so_far": F.collect_list("run_time").over(so_far)})


def one_user(events: DataFrame, user: str, who, order: list[str]) -> DataFrame:
    """Trace of a single user, in order."""
    return events.filter(F.col(user) == who).orderBy(*order)


def _changed(page: Column, before: Column) -> Column:
    return (~page.eqNullSafe(before)).cast("int")


def _local_runs(df: DataFrame, user: str, page: str, order: list[str]) -> DataFrame:
    """Row number, previous page and number of changes within (user, piece), and ``_opens``: the
    number of its first run if nothing stands before it."""
    inside = Window.partitionBy(user, PIECE).orderBy(*order)
    stepped = df.withColumns({"_row": F.row_number().over(inside), "_lag": F.lag(page).over(inside)})
    changed = ((F.col("_row") > 1) & ~F.col(page).eqNullSafe(F.col("_lag"))).cast("int")
    opens = (~F.col(page).eqNullSafe(F.lit(START))).cast("int")
    so_far = running([user, PIECE], order)
    return stepped.withColumns({"_local": F.sum(changed).over(so_far), "_opens": F.first(opens).over(so_far)})


def _run_carry(local: DataFrame, user: str, page: str, order: list[str]) -> DataFrame:
    """Per (user, piece) of users that are cut: ``_before``, the page standing before it, and
    ``_base``, the run number of its first row."""
    position = F.struct(*order)
    edges = local.filter(CUT).groupBy(user, PIECE).agg(
        F.min_by(F.struct(F.col(page).alias("page")), position).alias("first"),
        F.max_by(F.struct(F.col(page).alias("page")), position).alias("last"),
        F.max("_local").alias("inner"))
    by_piece = Window.partitionBy(user).orderBy(PIECE)
    opened = edges.withColumn("_before", F.lag("last").over(by_piece)).withColumn(
        "opens", (F.col("_before").isNull() & ~F.col("first.page").eqNullSafe(F.lit(START))
                  | F.col("_before").isNotNull() & ~F.col("first").eqNullSafe(F.col("_before"))).cast("int"))
    base = F.sum(F.col("opens") + F.col("inner")).over(running([user], [PIECE])) - F.col("inner")
    return opened.select(user, PIECE, "_before", base.alias("_base"))
