"""Whole plans: the corpus pipeline, job analytics, and the registered queries."""
