"""Corpus retrieval and analytics as DataFrame plans."""
