"""Surveillance analytics expressed as Spark plans."""
