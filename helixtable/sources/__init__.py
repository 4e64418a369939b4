"""Sources of the profile search engine."""
