"""Corpus analytics expressed as Spark DataFrame plans."""
