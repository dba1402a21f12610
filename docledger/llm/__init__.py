"""Operators of a training-data pipeline: tokens, language, quality, near copies, licences, contamination and more."""
