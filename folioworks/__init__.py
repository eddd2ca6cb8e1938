"""Spark jobs for digitised text collections and large text corpora."""
