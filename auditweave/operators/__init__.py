"""Batch operators: validate, curate, alert, decide, look up precedents, audit, report."""
