"""costmart.functions."""
