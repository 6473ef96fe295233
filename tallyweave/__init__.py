"""Reconciles a source snapshot of hierarchical, cross-referenced records with a target snapshot, as Spark jobs."""
