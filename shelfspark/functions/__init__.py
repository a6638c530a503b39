"""Column expression builders: plain functions from columns to a column."""
