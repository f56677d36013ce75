"""All registered queries; importing the modules fills the registry."""

from . import conversations, deliveries, filtering, logs, ordering, questions, samples, streams, tables, templates  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
