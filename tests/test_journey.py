"""Runs and journeys: brute force, hot users, long journeys and plan shape."""

import random

import pytest
from pyspark.sql import functions as F

from wordtrail.operators import journey
from wordtrail.operators.scan import find_cuts, running_sums, with_pieces

ORDER = ["ts", "event_id"]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        user = rng.choice([1, 1, 1, 2, 3, None])
        rows.append((i, rng.randrange(400), user, rng.choice(["a", "b", None]), float(rng.randrange(9))))
    rows += [(5000 + i, 1000 + i, 4, "a", 1.0) for i in range(100)]  # one run across all chunks
    return spark.createDataFrame(rows, "event_id long, ts long, user_id long, page string, value double").cache()


def brute(events):
    """(user, run) -> [page, time, converted] and event -> (previous, indicator, run, run_time)."""
    runs, marks, state = {}, {}, {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        before, run = state.get(r.user_id, ("started", 0))
        changed = int(r.page != before)
        run += changed
        state[r.user_id] = (r.page, run)
        entry = runs.setdefault((r.user_id, run), [r.page, 0.0, 0])
        entry[1] += r.value
        entry[2] = max(entry[2], int(r.page == "b"))
        marks[r.event_id] = (before, changed, run, entry[1])
    return runs, marks


@pytest.mark.parametrize("piece_rows", [10_000, 300, 20])
@pytest.mark.parametrize("order", [ORDER, ["place"]])
def test_runs_match_brute_force(events, piece_rows, order):
    runs, marks = brute(events)
    placed = events.withColumn("place", F.format_string("%06d-%06d", "ts", "event_id"))  # the same order as text
    cuts = find_cuts(placed, ["user_id"], order, piece_rows)
    assert (cuts is None) == (piece_rows == 10_000)
    marked = journey.mark_runs(placed, "user_id", "page", order, cuts)
    timed = journey.run_times(marked, "user_id", "value", order, cuts)
    assert {r.event_id: (r.previous_page, r.indicator, r.run, r.run_time) for r in timed.collect()} == marks
    converted = F.coalesce(F.col("page") == "b", F.lit(False))
    got = journey.collapse_runs(placed, "user_id", "page", "value", converted, order, cuts)
    assert {(r.user_id, r.run): [r.page, r.run_time, r.converted] for r in got.collect()} == runs


def test_no_window_holds_a_whole_user(events):
    """The largest (user, piece) stays near the asked size though one user has half of the rows."""
    cuts = find_cuts(events, ["user_id"], ORDER, 50)
    pieces = with_pieces(events, cuts, ["user_id"], ORDER)
    most = pieces.groupBy("user_id", "_piece").count().agg(F.max("count")).first()[0]
    assert most <= 200 < events.groupBy("user_id").count().agg(F.max("count")).first()[0]
    # pieces follow the order: none begins before the last row of the one before it
    ends = pieces.groupBy("user_id", "_piece").agg(F.min(F.struct(*ORDER)).alias("a"), F.max(F.struct(*ORDER)).alias("z")).collect()
    by = {(r.user_id, r._piece): r for r in ends}
    assert all(by[u, p - 1].z < r.a for (u, p), r in by.items() if (u, p - 1) in by)
    plan = journey.mark_runs(events, "user_id", "page", ORDER, cuts)._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if "Window [" in line and "_lag" in line]
    assert over and all("_piece" in line for line in over)


@pytest.mark.parametrize("piece_rows", [10_000, 60])
def test_journeys_in_parts_are_whole(events, piece_rows):
    runs, _ = brute(events)
    converted = F.coalesce(F.col("page") == "b", F.lit(False))
    cuts = find_cuts(events, ["user_id"], ORDER, piece_rows)
    collapsed = journey.collapse_runs(events, "user_id", "page", "value", converted, ORDER, cuts)
    parts = journey.journeys(collapsed, "user_id", cuts, part_size=50)
    walked, flags = {}, {}
    for r in parts.orderBy("user_id", "part").collect():
        assert len(r.pages) <= 50
        walked.setdefault(r.user_id, []).extend(zip(r.pages, r.times))
        flags.setdefault(r.user_id, set()).add(r.converted)
    assert set(walked) == {u for u, _ in runs}
    for user, steps in walked.items():
        mine = [v for (u, _), v in sorted(runs.items(), key=lambda kv: kv[0][1]) if u == user]
        assert steps == [(p, t) for p, t, _ in mine] and flags[user] == {max(c for _, _, c in mine)}


def test_lesson_example(spark):
    rows = [(1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (4, 1, "a"), (5, 2, "c")]
    df = spark.createDataFrame(rows, "ts long, user_id long, page string").withColumn("value", F.lit(1.0))
    lists = journey.user_journeys(df, "user_id", "page", "value", F.lit(0), ["ts"])
    assert {r.user_id: r.pages for r in lists.collect()} == {1: ["a", "b", "a"], 2: ["c"]}


def test_running_lists_are_slices_of_the_parts(events):
    known = events.fillna("-", ["page"]).filter("user_id IS NOT NULL")  # runs are numbered without gaps
    collapsed = journey.collapse_runs(known, "user_id", "page", "value", F.lit(0), ORDER, None)
    walked = journey.running_lists(collapsed, "user_id").select("user_id", "run", "pages_so_far")
    whole = journey.journeys(collapsed, "user_id", None, part_size=20).select("user_id", "part", "pages")
    placed = journey.list_positions(collapsed, part_size=20)
    assert placed.filter("part > 0").count() > 0  # some users are longer than a part
    sliced = placed.join(whole, ["user_id", "part"]).withColumn("ends", F.slice("pages", 1, F.col("position")))
    both = sliced.join(walked, ["user_id", "run"])
    assert both.count() == collapsed.count()
    assert both.filter(F.slice("pages_so_far", F.col("part") * 20 + 1, F.col("position")) != F.col("ends")).isEmpty()


@pytest.mark.parametrize("piece_rows", [10, 1000])
def test_running_sums_without_keys(spark, piece_rows):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("x"), F.lit(2).alias("v"))
    sums = running_sums(df, [], ["x"], {"total": F.col("v")}, piece_rows)
    assert sums.columns == ["x", "v", "total"] and all(r.total == 2 * (r.x + 1) for r in sums.collect())


def test_empty_events(spark, events):
    none = events.limit(0)
    assert find_cuts(none, ["user_id"], ORDER, 1) is None
    assert journey.user_journeys(none, "user_id", "page", "value", F.lit(0), ORDER).count() == 0


def test_journey_plan_shuffles_once_and_stays_in_the_jvm(spark, folder):
    from wordtrail import plans

    df = plans.all_queries()["c3_journeys"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_one_user_filter_reaches_the_scan(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    marked = journey.mark_runs(events, "user_id", "event_type", ORDER, None)
    plan = journey.one_user(marked, "user_id", 3, ORDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan and "html" not in plan
