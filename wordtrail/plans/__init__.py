"""Named queries over the standard tables, each with the SQL it is checked against."""

from wordtrail.plans import (formulas, journeys, learned, relational, samples, storage, texts,
                             votes)
from wordtrail.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql", "formulas", "journeys", "learned", "relational", "samples",
           "storage", "texts", "votes"]
