"""quadlab functions."""
