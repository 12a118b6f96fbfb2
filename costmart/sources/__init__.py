"""costmart.sources."""
