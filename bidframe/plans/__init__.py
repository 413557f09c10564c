"""Registered queries: operators applied to stand-in tables, each with its SQL."""

from bidframe.plans import decisions, ingest, models, more, pricing, quality, text, views  # noqa: F401
from bidframe.plans import files  # noqa: F401  (after views, whose SQL it reads)
from bidframe.plans.registry import ORACLE, QUERIES  # noqa: F401
