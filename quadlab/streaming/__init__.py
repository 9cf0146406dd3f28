"""quadlab streaming."""
