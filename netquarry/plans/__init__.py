"""End-to-end analysis and the catalog of queries."""
