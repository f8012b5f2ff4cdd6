"""All queries of the library but those of the corpus operators."""

from corpusmill.plans import aligning, analytics, auditing, changing, clustering, cohering, feeding, graphs, incidents, legacy, lines, metadata, ordered, ranking, relations, remedies, retrieving, scalars, searching  # noqa: F401
from corpusmill.plans.registry import REGISTRY as QUERIES

__all__ = ["QUERIES"]
