"""strandline: tool catalogs, plans, event streams and sessions as Spark DataFrame transforms."""
