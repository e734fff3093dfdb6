"""Sources, generators and sinks of records."""
