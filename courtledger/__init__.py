"""Sports-results analytics as plain PySpark DataFrame functions.

``functions``  column expressions and the period calendar
``sources``    journal, stored tables, dimensions, adapters for sample tables
``operators``  standings, leaders, results, event flattening, upserts
``plans``      the seven public reports over stored tables, and their JSON
``streaming``  the journal-to-tables ingestion job
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
