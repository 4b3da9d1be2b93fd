"""Loading, discovering, importing and exporting tables."""
