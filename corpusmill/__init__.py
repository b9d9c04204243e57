"""Corpus, manifest and evidence analytics as Spark jobs."""
