"""Spark engine that turns long documents into clean, structured, narration-ready text."""
