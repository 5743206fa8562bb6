"""adlens.operators."""
