"""All registered queries."""

from glossloom.plans import corpus, models, seqs, splitting, streams  # noqa: F401
from glossloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
