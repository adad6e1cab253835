"""Sources and sinks: raw records, ingest, stored review tables."""
