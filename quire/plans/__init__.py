"""Registered queries. Importing the package fills the registry."""

from quire.plans import (  # noqa: F401
    job_queries,
    layout_queries,
    markup_queries,
    page_queries,
    plugin_queries,
    source_queries,
    translation_queries,
    validation_queries,
)
from quire.plans.registry import ORACLES, QUERIES  # noqa: F401
