"""Readers of landed feeds and writers of stories, on Spark's own formats."""
