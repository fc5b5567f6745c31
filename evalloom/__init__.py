"""Evaluation-data tables on Spark: build, grade, merge and aggregate."""

__version__ = "0.1.0"
