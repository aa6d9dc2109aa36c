"""End-to-end jobs and the registry of queries over the driver tables."""
