"""Functions of the profile search engine."""
