"""recordflow: ordering, deduplication and verification of record data on Spark."""
