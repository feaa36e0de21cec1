"""Spark-native cohort scoring, integrity auditing and evidence synthesis.

Layers
------
``functions``  Column expressions, distribution tails, segmented scans, exact percentiles.
``sources``    readers, one-time ingest jobs and sinks.
``operators``  DataFrame -> DataFrame operators (QC, scores, effects, audits, gates, search).
``plans``      the multi-step jobs: cells -> scores -> effects -> synthesis.
"""

__version__ = "0.1.0"
