"""Relational analytics over labelled image and volume segmentations on Spark."""
