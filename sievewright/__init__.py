"""Corpus hygiene analytics on Spark."""
