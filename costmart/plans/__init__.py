"""costmart.plans."""
