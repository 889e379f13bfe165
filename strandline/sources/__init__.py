"""Sources and sinks: catalogs, pipeline files, documents, event logs, SSE frames, configuration."""
