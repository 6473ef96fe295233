"""Snapshots to reconcile, and where they come from."""
