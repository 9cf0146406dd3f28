"""quadlab operators."""
