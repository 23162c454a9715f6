"""Readers, writers, derived estate tables, change batches and the dirtied twin."""
