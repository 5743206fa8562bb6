"""adlens.sources."""
