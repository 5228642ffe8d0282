"""Derived views over the driver tables and the registered queries."""

from tracemill.plans import activity, files, ingestion, intake, retrieval, streams, usage  # noqa: F401
from tracemill.plans.registry import REGISTRY  # noqa: F401
