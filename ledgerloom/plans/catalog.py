"""Imports every query family so the registry is complete."""

from . import ledger_sql  # noqa: F401
from . import ledger_queries, report_queries, check_queries, recon_queries, tax_queries, insight_queries, schema_queries, privacy_queries, source_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
