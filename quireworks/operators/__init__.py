"""Document-layout operators."""
