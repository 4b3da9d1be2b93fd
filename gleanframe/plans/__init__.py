"""Specs and their translation to Spark columns: filters, table queries, page cursors."""
