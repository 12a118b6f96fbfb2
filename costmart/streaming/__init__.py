"""costmart.streaming."""
