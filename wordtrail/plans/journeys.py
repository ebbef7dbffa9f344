"""Window operators and journeys over events and conversations (W, C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wordtrail.operators import factors, features, journey, skipgram
from wordtrail.operators.scan import find_cuts
from wordtrail.plans.registry import Tables, query

ORDER = ["ts", "event_id"]


def converted():
    return F.col("event_type") == "purchase"


MARKED = """
a AS (SELECT *, lag(event_type, 1, 'started') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_page FROM events),
b AS (SELECT *, CASE WHEN event_type = previous_page THEN 0 ELSE 1 END AS indicator FROM a),
m AS (SELECT *, sum(indicator) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint AS run FROM b)"""
RUNS = MARKED + """,
r AS (SELECT user_id, run, max(event_type) AS page, sum(value) AS run_time,
             max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS converted FROM m GROUP BY 1, 2)"""


def cut_points(t: Tables) -> DataFrame | None:
    return find_cuts(t.events, ["user_id"], ORDER)


def marked(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    return journey.mark_runs(events, "user_id", "event_type", ORDER, cut_points(t))


def runs(t: Tables) -> DataFrame:
    return journey.collapse_runs(t.events, "user_id", "event_type", "value", converted(), ORDER, cut_points(t))


@query("w1_previous_page", f"WITH {MARKED} SELECT event_id, user_id, previous_page FROM m")
def previous_page(t):
    return marked(t).select("event_id", "user_id", "previous_page")


@query("w2_change_indicator", f"WITH {MARKED} SELECT event_id, indicator FROM m")
def change_indicator(t):
    return marked(t).select("event_id", "indicator")


@query("w3_run_number", f"WITH {MARKED} SELECT event_id, user_id, run FROM m")
def run_number(t):
    return marked(t).select("event_id", "user_id", "run")


@query("w4_running_time", f"""
WITH {MARKED} SELECT event_id, run, round(sum(value) OVER (
  PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS run_time FROM m""")
def running_time(t):
    timed = journey.run_times(marked(t), "user_id", "value", ORDER, cut_points(t))
    return timed.select("event_id", "run", F.round("run_time", 4).alias("run_time"))


@query("w5_last_of_run", f"""
WITH {MARKED} SELECT user_id, run, max_by(event_type, ts) AS final_page, max_by(event_id, ts) AS final_event,
  round(max_by(value, ts), 4) AS final_value FROM m GROUP BY 1, 2""")
def last_of_run(t):
    position = F.struct(*ORDER)
    last = marked(t).groupBy("user_id", "run").agg(
        F.max_by(F.struct("event_type", "event_id", "value"), position).alias("last"))
    return last.select("user_id", "run", F.col("last.event_type").alias("final_page"),
                       F.col("last.event_id").alias("final_event"), F.round("last.value", 4).alias("final_value"))


@query("w6_running_lists", f"""
WITH {RUNS} SELECT user_id, run, ((run - 1) // 10000)::integer AS part, ((run - 1) % 10000 + 1)::integer AS position, page FROM r""")
def running_lists(t):
    """The list so far of a run is the slice of its part in w7 up to its position."""
    return journey.list_positions(runs(t)).select("user_id", "run", "part", "position", "page")


@query("w7_final_lists", f"""
WITH {RUNS} SELECT user_id, ((run - 1) // 10000)::integer AS part, string_agg(page, '>' ORDER BY run) AS pages,
  round(list_sum(list(run_time)), 4) AS total FROM r GROUP BY 1, 2""")
def final_lists(t):
    final = journey.journeys(runs(t), "user_id", cut_points(t))
    total = F.aggregate("times", F.lit(0.0), lambda s, v: s + v)
    return final.select("user_id", "part", F.array_join("pages", ">").alias("pages"), F.round(total, 4).alias("total"))


@query("c1_page_popularity", "SELECT event_type AS page, count(*) AS views, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def page_popularity(t):
    return journey.page_popularity(t.events.select("user_id", F.col("event_type").alias("page")))


@query("c2_collapsed_runs", f"WITH {RUNS} SELECT user_id, run, page, round(run_time, 4) AS run_time, converted FROM r")
def collapsed_runs(t):
    return runs(t).withColumn("run_time", F.round("run_time", 4))


JOURNEY_SQL = f"""
WITH {RUNS} SELECT user_id, ((run - 1) // 10000)::integer AS part, string_agg(page, '>' ORDER BY run) AS journey,
  string_agg(round(run_time * 100)::bigint::varchar, '>' ORDER BY run) AS times,
  max(max(converted)) OVER (PARTITION BY user_id) AS converted, count(*) AS n FROM r GROUP BY 1, 2"""


@query("c3_journeys", JOURNEY_SQL)
def journeys(t):
    lists = journey.user_journeys(t.events, "user_id", "event_type", "value", converted(), ORDER)
    cents = F.transform("times", lambda v: F.round(v * 100).cast("bigint").cast("string"))
    return lists.select("user_id", "part", F.array_join("pages", ">").alias("journey"),
                        F.array_join(cents, ">").alias("times"), "converted",
                        F.size("pages").cast("bigint").alias("n"))


@query("c3_conversation_journeys", """
WITH a AS (SELECT *, lag(role, 1, 'started') OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
m AS (SELECT *, sum(CASE WHEN role = p THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM a),
r AS (SELECT conv_id, run, max(role) AS page, sum(length(text)) AS chars FROM m GROUP BY 1, 2)
SELECT conv_id, ((run - 1) // 10000)::integer AS part, string_agg(page, '>' ORDER BY run) AS journey,
  sum(chars)::bigint AS chars FROM r GROUP BY 1, 2""")
def conversation_journeys(t):
    turns = t.conversations.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("chars"))
    lists = journey.user_journeys(turns, "conv_id", "role", "chars", F.lit(0), ["turn"])
    chars = F.aggregate("times", F.lit(0).cast("bigint"), lambda s, v: s + v)
    return lists.select("conv_id", "part", F.array_join("pages", ">").alias("journey"), chars.alias("chars"))


@query("c4_one_user", f"""
WITH {MARKED} SELECT event_id, previous_page, event_type, indicator, run FROM m WHERE user_id = 3 ORDER BY ts, event_id""")
def one_user(t):
    trace = journey.one_user(marked(t), "user_id", 3, ORDER)
    return trace.select("event_id", "previous_page", "event_type", "indicator", "run")


PAGES_SQL = f"WITH {MARKED} SELECT event_type AS word FROM m WHERE indicator = 1 GROUP BY 1 HAVING count(*) >= 5"


@query("c5_page_embeddings", f"SELECT word, 100 AS size, 2 AS position_size FROM ({PAGES_SQL})")
def page_embeddings(t):
    lists = journey.user_journeys(t.events, "user_id", "event_type", "value", converted(), ORDER)
    vectors = skipgram.word_vectors(lists, "pages")
    return features.project(vectors, "vector", 2, "position").select("word", F.size(
        features.vector_to_array("vector")).alias("size"), F.size(features.vector_to_array("position")).alias("position_size"))


@query("c5_page_similarity", f"SELECT word, true AS is_cosine FROM ({PAGES_SQL}) WHERE word <> 'purchase'")
def page_similarity(t):
    lists = journey.user_journeys(t.events, "user_id", "event_type", "value", converted(), ORDER)
    vectors = skipgram.word_vectors(lists, "pages")
    return features.similar_words(vectors, "purchase").select("word", (F.abs("similarity") <= 1.000001).alias("is_cosine"))


@query("c5_page_neighbours")
def page_neighbours(t):
    """Cosines of the pages' own vectors to that of one page."""
    lists = journey.user_journeys(t.events, "user_id", "event_type", "value", converted(), ORDER)
    vectors = factors.word_factors(factors.associations(factors.cooccurrences(lists, "pages")))
    return features.similar_words(vectors, "purchase")
