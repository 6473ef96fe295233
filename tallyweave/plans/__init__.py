"""A reconcile run from snapshots to report, and the registered queries."""
