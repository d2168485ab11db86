"""Document-layout functions."""
