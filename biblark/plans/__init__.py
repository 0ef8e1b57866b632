"""The library's data model over given tables, and the registry of queries."""
