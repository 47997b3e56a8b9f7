"""trellis.sources."""
