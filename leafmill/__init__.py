"""Leafmill: document-library and news analytics expressed as Spark plans."""
