"""All registered queries."""

from mediatally.plans import (  # noqa: F401
    detect_queries,
    fetch_queries,
    manifest_queries,
    stream_queries,
    scalar_queries,
    timeline_queries,
)
from mediatally.plans.registry import ORACLES, QUERIES  # noqa: F401
