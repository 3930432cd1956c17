"""All registered queries of the library, but for those of the optional text package."""

from eventalpha.plans import event_queries, flagship, io_queries, perf_queries, signal_queries, text_queries  # noqa: F401
from eventalpha.plans.base import QUERIES, SQL  # noqa: F401
