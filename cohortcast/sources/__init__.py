"""Sources and sinks: base tables, fixture views, landed extracts, result sinks."""
