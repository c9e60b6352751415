"""Sources and sinks: CSV/JSON ingest with NA tokens and one-pass type
inference, frozen schemas, dataset catalog (save/list/drop), validation."""
