"""Composite results: cohort summaries, per-subject timelines, differential tables."""
