"""Readers and writers of corpora, anchors and vector spaces."""
