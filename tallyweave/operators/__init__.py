"""Relational operators: selection, closure, matching, planning, conflicts, mapping, apply and report."""
