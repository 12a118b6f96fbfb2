"""costmart.operators."""
