"""Quarryline: a PySpark-native analytics engine for logs, chunk stores, lineage, text and vectors."""
