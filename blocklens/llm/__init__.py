"""Operators of a large training-data pipeline: counting, de-duplicating, scoring, mixing and encoding documents."""
