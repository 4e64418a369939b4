"""Plans of the profile search engine."""
