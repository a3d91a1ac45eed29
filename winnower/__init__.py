"""Screening, ranking and selection of records as Spark plans."""
