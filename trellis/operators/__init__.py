"""trellis.operators."""
