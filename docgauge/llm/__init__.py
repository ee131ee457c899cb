"""Operators of a training-data pipeline: decontamination, quality, language, scoring, mixing, formatting, search, dedup."""
