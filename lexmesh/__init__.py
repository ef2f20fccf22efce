"""Lexical-space analytics on Spark: corpus ingestion, anchors, vector spaces and anomaly lenses."""
