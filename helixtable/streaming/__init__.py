"""Streaming of the profile search engine."""
