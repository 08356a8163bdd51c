"""Sequence analytics on Spark: curation, descriptors, similarity, edits, inference, scoring."""
