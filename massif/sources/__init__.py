"""Table, JSON and run-registry input and output."""
