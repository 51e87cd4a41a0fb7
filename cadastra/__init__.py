"""Spark-first analytics over parcel panels: ingest, spatial joins, price panels and linear models."""
