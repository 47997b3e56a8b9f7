"""trellis.functions."""
