"""Sources and sinks: given tables, fixture views, CSV/JSON ingest, writers."""
