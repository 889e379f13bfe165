"""DataFrame operators: sequences, lookups, type compatibility, catalogs, events."""
