"""quadlab plans."""
