"""Sources and sinks: declared schemas, CSV scans, driver-table bindings and
the vector index tables."""
