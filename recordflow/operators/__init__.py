"""Operators over records: filters, sorts, distinct, groups, merges, runs and checks."""
