"""Operators of the profile search engine."""
