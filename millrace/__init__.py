"""Millrace: tabular, nested and text analytics expressed as Spark DataFrame plans."""
