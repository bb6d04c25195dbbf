"""Event curation and decision auditing as Spark DataFrame transforms."""

__version__ = "0.1.0"
