"""Document-layout sources."""
