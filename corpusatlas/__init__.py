"""Corpus Atlas: catalogue, resolve, contextualise and enrich corpora with Spark."""
