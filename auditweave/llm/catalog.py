"""All training-data queries."""

from auditweave.llm import bpe, chaining, minmax, mixing, neighbours, packing, periods, quality, simhash, suffixes, toxicity, turns, wrappers  # noqa: F401
from auditweave.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
