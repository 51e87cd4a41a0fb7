"""Readers and writers of the panel's files; everything goes through Spark's file systems."""
