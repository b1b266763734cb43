"""Provenance analytics on Spark: scored lineage claims, batch graph queries, file-set analysis."""
