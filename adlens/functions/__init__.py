"""adlens.functions."""
