"""adlens.streaming."""
