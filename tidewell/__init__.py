"""Tidewell: an evidence-pipeline and training-data engine on PySpark."""
