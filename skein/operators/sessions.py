"""Sessions: the last turns as context, and the bounded search loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.retrieval import route
from skein.session import cut_lineage

TURNS, TURN_CHARS, MOST_TRIES = 3, 500, 2


def last_turns(rows: DataFrame, session: str, order: list[str], text: str, turns: int = TURNS, chars: int = TURN_CHARS) -> DataFrame:
    """A session's last ``turns`` texts in order, each cut to ``chars``: session, context."""
    newest = F.row_number().over(Window.partitionBy(session).orderBy(*[F.desc(c) for c in order]))
    kept = rows.withColumn("__newest", newest).where(F.col("__newest") <= turns)
    parts = F.sort_array(F.collect_list(F.struct(-F.col("__newest"), F.substring(text, 1, chars).alias("text"))))
    return kept.groupBy(session).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("context"))


def search_loop(queries: DataFrame, search: Callable[[DataFrame, int], DataFrame], most: int = MOST_TRIES) -> DataFrame:
    """Search, judge, search again for what is not good enough: query_id, tries, best, step (answer or clarify).

    ``search(queries, attempt)`` returns query_id, best for the given queries. The loop ends after
    ``most`` repeats at the latest; each round works on the queries still open, all at once.
    """
    done, open_queries = None, queries.select("query_id").distinct()
    for attempt in range(most + 1):
        found = open_queries.join(search(open_queries, attempt), "query_id", "left").withColumn("tries", F.lit(attempt))
        judged = cut_lineage(found.withColumn("step", route(F.col("best"), F.col("tries"))))
        closed = judged.where("step <> 'reformulate'")
        done = closed if done is None else done.unionByName(closed)
        open_queries = judged.where("step = 'reformulate'").select("query_id")
    return done.select("query_id", "tries", "best", "step")
