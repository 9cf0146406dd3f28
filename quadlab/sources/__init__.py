"""quadlab sources."""
