"""All registered queries."""

from auditweave.plans import auditing, curation, decisions, ingest, streams  # noqa: F401
from auditweave.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
