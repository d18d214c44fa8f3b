"""The operators bound to the test tables, each with the SQL that says the same."""

from bindings import (  # noqa: F401
    aggregates, functions, jobs, joins, landed, projections, sinks, sources, streams, windows,
)
from bindings.base import QUERIES, SQL  # noqa: F401
