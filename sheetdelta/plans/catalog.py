"""All named queries."""

from sheetdelta.plans import (  # noqa: F401
    queries_cells,
    queries_geometry,
    queries_history,
    queries_match,
    queries_report,
    queries_review,
    queries_stream,
    queries_text,
)
from sheetdelta.plans.registry import CHECKS, QUERIES  # noqa: F401
